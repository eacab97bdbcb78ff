"""The near-duplicate stage on shared ids, repeated rows and many small blocks."""

from collections import Counter

import numpy as np
import pytest
from test_llm_operators import plain_components

from runlens.llm import near


def story(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_no_text_is_lost_where_ids_are_shared(spark):
    a, b = story("a"), story("b")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (5, f"{b} more", "x"), (7, story("c"), "x"), (7, story("c"), "x"), (7, story("c"), "y"), (None, a, "x"), (8, None, "x"),
            (8, None, "x"), (9, "", "x"), (None, None, "x")]
    kept = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string"))
    assert kept.columns == ["doc_id", "text", "a.b"]
    assert Counter((r[0], r[1]) for r in kept.collect()) == Counter([(1, a), (2, b), (7, story("c")), (None, a), (8, None), (9, ""), (None, None)])
    assert near.one_of_each(kept.limit(0)).count() == 0


def test_one_of_each_against_plain_python(spark):
    """A third of all ids shared by different texts."""
    random = np.random.default_rng(3)
    texts = []
    for i in range(120):
        w = story(f"f{i % 12}_", 60).split()
        for at in random.choice(60, random.integers(0, 3), replace=False):
            w[at] = f"v{random.integers(0, 3)}"
        texts.append(" ".join(w))
    ids = [int(i if i % 3 else random.integers(0, 20)) for i in range(120)]
    components = plain_components(list(enumerate(texts)), 5, 80)
    groups = {}
    for i, (_, c) in components.items():
        groups.setdefault(c, set()).add((ids[i], texts[i]))
    kept = [tuple(r) for r in near.one_of_each(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        assert [k[0] for k in kept if k in members] == [min(members)[0]]


@pytest.mark.parametrize(("block", "columns"), [(512, 4096), (9, 16)])
def test_blocks_find_the_links_of_a_family(spark, monkeypatch, block, columns):
    """Copies of one text that are far from their hub but near to one another."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "COLUMNS", columns)
    random = np.random.default_rng(11)
    rows = []
    for i in range(90):
        w = story("w", 80).split()
        for at in random.choice(80, random.integers(0, 8), replace=False):
            w[at] = f"v{random.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    expected = plain_components(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def test_links_of_a_block():
    random = np.random.default_rng(4)
    hub = set(range(50))
    sets = [(hub - set(random.choice(50, 6).tolist())) | set((100 + random.choice(8, 4)).tolist()) for _ in range(30)]
    apart = [sorted(s ^ hub) for s in sets]
    sides = random.random(30) < 0.4
    at = np.concatenate([[0], np.cumsum([len(a) for a in apart])])
    component = np.where(random.random(30) < 0.5, np.arange(30), 0)
    found = near.block_links(sides, np.arange(30), component, np.array([len(s) for s in sets]), np.concatenate(apart), at, 70)
    root = {i: i for i in range(30)}
    for i in range(30):
        for j in range(30):
            if sides[i] and not sides[j] and component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                old = {root[i], root[j]}
                root = {k: min(old) if r in old else r for k, r in root.items()}
    assert dict(zip(*(x.tolist() for x in found))) == {i: r for i, r in root.items() if i != r}
