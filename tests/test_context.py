import random

from quillmill.functions import context as T


def plain(code, numbers, texts, budget):
    """Which lines are shown, window by window, as a set of lines; rows made of it."""
    lines = code.split("\n")
    cost = lambda s: len(s) // 2 + s.count("\n")
    full = "\n".join(f"{i + 1}| {x}" for i, x in enumerate(lines))
    at = sorted({n for n in numbers if n and 1 <= n <= len(lines)})
    if cost(full) <= budget or not at:
        return full
    for radius in (80, 40, 20, 16, 16, 16):
        out, last = [], 0
        shown = sorted({i for a in at for i in range(a - radius, a + radius + 1) if 1 <= i <= len(lines)})
        for i in shown:
            if i > last + 1:
                out.append(f"# …… 省略 L{last + 1}-L{i - 1}（超长上下文窗口化）……")
            out.append(f"{i}| {lines[i - 1]}")
            last = i
        if last < len(lines):
            out.append(f"# …… 省略 L{last + 1}-L{len(lines)}（超长上下文窗口化）……")
        if cost("\n".join(out)) <= budget:
            break
    return "\n".join(out)


def test_against_a_plain_packing():
    rng = random.Random(1)
    cut = 0
    for _ in range(300):
        code = "\n".join("x" * rng.randrange(60) for _ in range(rng.randrange(1, 500)))
        numbers = [rng.choice([None, 0, rng.randrange(1, 520)]) for _ in range(rng.randrange(4))]
        budget = rng.choice([50, 400, 2000, 9000])
        got = T.windowed(code, numbers, [], budget)
        assert got == plain(code, numbers, [], budget)
        cut += "省略" in got
    assert cut > 30


def test_long_lines_and_anchors_from_texts():
    long = "a" * 9000 + "needle_in_hay(x)" + "b" * 9000
    got = T.windowed("first\n" + long + "\nlast", [2], ["needle_in_hay(x)"], 100)
    assert "第 2 行为超长行（18016 字符" in got and "needle_in_hay" in got and "# ==== 列 L8500-9500（全文 18016 字符）====" in got
    code = "\n".join(["plain words here"] * 200 + ["special_call(argument)"] + ["plain words here"] * 200)
    assert "201| special_call(argument)" in T.windowed(code, [], ["x", "special_call(other)"], 900)
    assert "42| plain" in T.windowed(code, [0, None], ["see line 42: there"], 900)
    assert T.windowed(code, [999], ["nothing_like_it"], 10) == T.numbered(code.split("\n"), 1)
    assert T.windowed(None, [1], [], 5) is None and T.windowed("", None, None, 5) == "1| "


def test_column(spark):
    code = "\n".join(f"line {i}" for i in range(1000))
    df = spark.createDataFrame([(1, code, [500, None], ["a"]), (2, None, None, None), (3, "", [], [])], "k int, c string, n array<int>, t array<string>")
    got = {r.k: r.w for r in df.select("k", T.windowed_context("c", "n", "t", 300).alias("w")).collect()}
    assert got[1] == T.windowed(code, [500], ["a"], 300) and got[2] is None and got[3] == "1| "
