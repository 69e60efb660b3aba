import difflib
import random
import re

import pytest

from quillmill.functions import anchors as A

CODE = (
    "import os\nfrom flask import Flask, request\n\napp = Flask(__name__)\nBASE_DIR = '/var/www/uploads'\n\n\n@app.route('/view')\ndef view():\n"
    "    filename = request.args.get('file', '')\n    full_path = os.path.join(BASE_DIR, filename)\n    with open(full_path, 'r') as f:\n        return f.read()\n"
)
TWICE = "x = 1\nq = 'select * from t'\ncursor.execute(q)\n" + "y = 2\nz = 3\nw = 4\nv = 5\nu = 6\ns = 7\nt = 8\nr = 9\n" + "cursor.execute(q)\nprint('done')\n"


@pytest.mark.parametrize(
    "text, want, code",
    [
        ("line 7: request.args.get('file') 用户可控路径参数", "line 10: request.args.get('file') 用户可控路径参数", CODE),
        ("line 10: open(full_path) 直接打开拼接后的路径", "line 12: open(full_path) 直接打开拼接后的路径", CODE),
        ("line 10: request.args.get('file', '') 用户可控路径参数", "line 10: request.args.get('file', '') 用户可控路径参数", CODE),
        ("no mark of a line", "no mark of a line", CODE),
        ("line 3: 这段代码在源码里不存在", "line 3: 这段代码在源码里不存在", CODE),
        ("line 7: request.args.get('file'); line 8: os.path.join(BASE_DIR, filename)", "line 10: request.args.get('file'); line 11: os.path.join(BASE_DIR, filename)", CODE),
        ("第 7 行: request.args.get('file') 用户可控路径参数", "line 10: request.args.get('file') 用户可控路径参数", CODE),
        ("line 7: request.args.get('file') user-controlled path param", "line 10: request.args.get('file') user-controlled path param", CODE),
        ("lines 7-9: request.args.get('file')", "line 10: request.args.get('file')", CODE),
        ("line 2: cursor.execute(q)", "line 3: cursor.execute(q)", TWICE),
        ("line 12: cursor.execute(q)", "line 12: cursor.execute(q)", TWICE),
        # what isn't found goes along by as much as all that is found; not beyond the text
        ("line 7: request.args.get('file') line 8 直接拼入", "line 10: request.args.get('file') line 11:直接拼入", CODE),
        ("line 7: request.args.get('file') line 90 直接拼入", "line 10: request.args.get('file') line 90 直接拼入", CODE),
    ],
)
def test_golden(text, want, code):
    assert A.reanchor(text, code)[0] == want


def plain_find(content, lines, cited):
    """Every line against the content, as the module's docstring says it."""
    content = content.strip().rstrip(A.TAIL)
    whole, plain = A.normal(content), A.normal(re.sub(A.CJK, "", content))
    pieces = [x.replace("'", "").replace('"', "").lower() for x in content.split() if len(x) >= 8]
    best = None
    for i, line in enumerate(lines):
        if not whole or re.match(A.DECLARES, line):
            continue
        n, p = A.normal(line), A.normal(re.sub(A.CJK, "", line))
        if whole == n or (plain and plain == p) or (len(whole) >= 8 and whole in n) or (len(plain) >= 8 and plain in p):
            s = 1.0
        elif any(x and x in n for x in pieces):
            s = 0.95
        elif not set(re.findall(r"\w+", content.lower())) & set(re.findall(r"\w+", line.lower())):
            s = 0.0
        else:
            s = max([difflib.SequenceMatcher(None, x, n).ratio() for x in pieces if x] + [difflib.SequenceMatcher(None, plain, p).ratio() if plain and p else 0.0])
        if s >= 0.6 and (best is None or (-s, abs(i + 1 - cited), i) < best):
            best = (-s, abs(i + 1 - cited), i)
    return best and best[2] + 1


def test_index_finds_what_a_scan_of_all_lines_finds():
    rng = random.Random(4)
    names = ["user", "request", "cursor", "execute", "filename", "open", "render_template", "x", "total", "path.join", "日志"]
    moved = 0
    for _ in range(300):
        lines = [" ".join(rng.choice(names) + rng.choice(["(", " = ", ", ", "'"]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))]
        lines.insert(0, "import request")
        content = list(rng.choice(lines))
        for _ in range(rng.randrange(6)):
            content[rng.randrange(len(content))] = rng.choice(["", "z", " "])
        content, cited = "".join(content), rng.randrange(1, 35)
        index = A.LineIndex("\n".join(lines))
        got = index.find(content, cited)
        assert got == plain_find(content, index.lines, cited)
        moved += got is not None and got != cited
    assert moved > 100


def test_column(spark):
    rows = [(1, "line 7: request.args.get('file')", CODE), (2, None, CODE), (3, "line 7: x", None), (4, "", ""), (5, "line 99999999999: cursor.execute(q)", TWICE)]
    got = {r.k: r.a for r in spark.createDataFrame(rows, "k int, t string, c string").select("k", A.reanchored("t", "c").alias("a")).collect()}
    assert got[1].text.startswith("line 10:") and [tuple(m) for m in got[1].moves] == [(7, 10)]
    assert got[2].text is None and got[3].text == "line 7: x" and got[4].text == "" and not got[4].moves
    assert got[5].text == "line 12: cursor.execute(q)"
