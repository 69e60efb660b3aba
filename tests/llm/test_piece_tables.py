import random

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import piece_sampling as P


@pytest.fixture(scope="module")
def coder():
    return P.Coder(P.vocabulary_path())


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshr日é") for _ in range(rng.randint(1, 12))) for _ in range(n))


def test_edges_of_each_node_are_its_pieces_with_their_shares(coder):
    t = P.Lattices(coder.v)
    t.add([P.MARK + "there", P.MARK + "日本", "s"])
    t.add([P.MARK + "tion"])
    unit, v = P.MARK + "tion", coder.v
    total = [1.0]
    for j in range(1, len(unit) + 1):
        ways = [(v.weight[v.id_of[unit[i:j]]] * total[i], v.id_of[unit[i:j]], i) for i in range(j) if unit[i:j] in v.id_of]
        total.append(sum(w for w, *_ in ways))
        node = t.last[unit] - len(unit) + j
        at = t.first[node]
        stop = t.first[node + 1] if node + 1 < t.nodes else t.held
        assert t.piece[at:stop].tolist() == [k for _, k, _ in ways]
        shares = np.cumsum([w for w, *_ in ways]) / total[-1]
        assert np.allclose(t.share[at:stop] / 2**P.SHARE_BITS, shares, atol=1e-8) and t.share[stop - 1] == 1 << P.SHARE_BITS
        assert [b - (t.last[unit] - len(unit)) if b >= 0 else 0 for b in t.back[at:stop].tolist()] == [i for *_, i in ways]


def test_shares_do_not_depend_on_their_place(coder):
    """Beside node numbers of over 2 ** 23, shares of 30 bits were rounded."""
    units = [P.MARK + w for w in words(random.Random(1), 500).split()]
    here, far = P.Lattices(coder.v), P.Lattices(coder.v)
    far.nodes, far.first = 1 << 25, np.zeros((1 << 25) + (1 << 16), np.int32)
    here.add(units)
    far.add(units)
    assert here.held == far.held and (here.share[: here.held] == far.share[: here.held]).all()
    seeds = P._mix(np.arange(len(units), dtype=np.uint64))
    (a, n), (b, m) = (t.sample(np.array([t.last[u] for u in units]), seeds) for t in (here, far))
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_cleared_tables_and_slabs_give_the_same(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, 300) for _ in range(30)] + ["x" * 9000, "", "日" * 5000]
    seeds = [P.row_seed(str(i)) for i in range(len(texts))]
    whole = [x.tolist() for x in P.Coder(P.vocabulary_path()).encode(texts, seeds)]
    monkeypatch.setattr(P, "SLAB_NODES", 50)
    monkeypatch.setattr(P, "MAX_NODES", 100)
    small = P.Coder(P.vocabulary_path())
    assert [small.encode([t], [s])[0].tolist() for t, s in zip(texts, seeds, strict=True)] == whole


def test_a_table_takes_as_much_room_as_it_has_edges(coder):
    """Sixteen bytes an edge before; a node's edges are now found without a search among all."""
    t = P.Lattices(coder.v)
    t.add([P.MARK + w for w in words(random.Random(2), 3000).split()])
    held = sum(x[: t.held].nbytes for x in (t.share, t.piece, t.back))
    assert held == 12 * t.held and len(t.first) >= t.nodes


def test_a_text_of_many_words_stays_within_the_table(monkeypatch):
    """All units of up to 256 texts went into one table before, however many they were."""
    text, seed = words(random.Random(5), 6000), P.row_seed("1")
    whole = P.Coder(P.vocabulary_path()).encode([text], [seed])[0].tolist()
    most = 0
    add = P.Lattices.add

    def watched(self, units):
        nonlocal most
        add(self, units)
        most = max(most, self.nodes)

    monkeypatch.setattr(P.Lattices, "add", watched)
    monkeypatch.setattr(P, "MAX_NODES", 5000)
    monkeypatch.setattr(P, "PART_CHARS", 2000, raising=False)
    assert P.Coder(P.vocabulary_path()).encode([text], [seed])[0].tolist() == whole
    assert 5000 < most <= 5000 + 2000


def test_ids_leave_a_worker_some_rows_at_a_time(monkeypatch):
    """A whole batch of 10,000 rows and its ids were held before; no row is lost where runs and batches end."""
    texts = ["", None, "a b", "word " * 50, "日本 " * 40, None, "x", "y z"] * 3
    keys = [str(i) for i in range(len(texts))]
    batch = pa.array(keys), pa.array(texts)
    whole = P.Coder(P.vocabulary_path()).encode([t or "" for t in texts], [P.row_seed(k) for k in keys])
    monkeypatch.setattr(P, "TEXTS", 3)
    monkeypatch.setattr(P, "TEXT_BYTES", 300)
    runs = list(P.piece_ids_of([batch], P.vocabulary_path(), P.SEED))
    assert [x for run in runs for x in run.to_pylist()] == [x.tolist() for x in whole]
    sizes = [len((t or "").encode()) for t in texts]
    at = 0
    for run in runs:
        assert len(run) == 1 or (len(run) <= 3 and sum(sizes[at : at + len(run)]) <= 300)
        at += len(run)
    assert len(runs) > 8
