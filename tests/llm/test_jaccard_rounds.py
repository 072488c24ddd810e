"""Rounds of the n-gram join: pairs that parities rule out are not compared, and links are no more than points."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skychan.llm import common, voronoi_join
from skychan.llm.voronoi_join import components, joined_points, linked, parities


def test_parities_never_exceed_the_difference():
    g = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        a = np.unique(g.integers(0, 1 << 62, n))
        b = np.unique(np.concatenate([a[: n // 2], g.integers(0, 1 << 62, n // 3)]))
        differ = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) and (n != 50 or differ > 20)


def test_links_as_many_as_points(spark):
    """All pairs of 60 points, and a chain of 40: fewer links, the same components."""
    rows = [(i, j) for j in range(60) for i in range(j)] + [(1000 + i * 7 % 41, 1000 + (i + 1) * 7 % 41) for i in range(40)]
    links = spark.createDataFrame(rows, "x long, y long")
    label, fewer = joined_points(links)
    assert fewer.count() <= 60 + 41
    for some in (links, fewer):
        assert {r.x: r.label for r in components(some).collect()} == {i: 0 for i in range(60)} | {1000 + i: 1000 for i in range(41)}
    assert all((r.label < 1000) == (r.x < 1000) for r in label.collect())


def test_unlike_points_of_a_region_are_not_compared(spark, monkeypatch):
    """Texts that share frequent n-grams, but not enough for a link: no round compares many whole sets."""
    common.ship(spark)
    g = np.random.default_rng(2)
    phrases = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(30)]
    rows = [(k, " ".join(phrases[i] for i in g.choice(30, 8, replace=False))) for k in range(400)]
    seen, plain = [], voronoi_join.overlaps

    def watched(asked, sets):
        seen.append(asked.count())
        return plain(asked, sets)

    monkeypatch.setattr(voronoi_join, "overlaps", watched)
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter(F.col("component_id") != F.col("doc_id")).isEmpty() and len(seen) and sum(seen) < 400


def test_near_copies_meet_in_one_region(spark, monkeypatch):
    """Near copies share many regions of rare n-grams: a pair is one row, not one for each region that both are in."""
    common.ship(spark)
    g = np.random.default_rng(4)
    rows = []
    for k in range(60):
        words = [f"w{j}" for j in range(300)]
        for j in g.choice(300, 2, replace=False):
            words[j] = f"own{k}"
        rows.append((k, " ".join(words)))
    frame = type(spark.range(0))
    seen, plain = [], frame.distinct

    def watched(self):
        out = plain(self)
        if self.columns == ["x", "p"]:
            seen.append((self.count(), out.count()))
        return out

    monkeypatch.setattr(frame, "distinct", watched)
    got = linked(spark.createDataFrame([*rows, (60, "other words " * 9)], "doc_id long, text string"), often=1_000_000, few=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 for k in range(60)} | {60: 60}
    assert seen and sum(a for a, _ in seen) <= 2 * sum(b for _, b in seen)


def test_words_are_hashed_as_they_are_split():
    """Hashes from bytes: equal for equal words in lower case only, at any place of any slice."""
    odd = ["", None, "  ", "A b\tC\x0bd\x0ce\rf\n", "a B c D E f", "é\x00É  x ü", "x" * 200 + " " + "X" * 200 + " " + "x" * 199 + "y", "abcdefgh abcdefghi abcdefg", "q", " end", "\x1c\x85 a"] * 2
    texts = common.plain_texts(pa.array(odd, pa.large_string()))
    for own in (texts, texts.slice(3, 9), texts.slice(0, 1), texts.slice(2, 1), texts.slice(0, 0)):
        words, off = common.words_of(own)
        hashes, begin = voronoi_join.word_hashes(own)
        assert begin.tolist() == off.tolist() and len(hashes) == len(words)
        assert len(set(zip(hashes.tolist(), words.to_pylist(), strict=True))) == len(set(hashes.tolist())) == len(set(words.to_pylist()))
    for s, words in zip(voronoi_join.shingle_sets(texts, 3), [(t or "").lower().replace("É".lower(), "É") for t in odd], strict=True):
        n = len(common.words_of(pa.array([words], pa.large_string()))[0])
        assert len(s) <= max(n - 2, min(n, 1)) and (len(s) > 0) == (n > 0) and (np.diff(s.view(np.int64)) != 0).all()


def test_frequent_are_told_from_rare():
    g = np.random.default_rng(6)
    frequent = np.unique(g.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    s = np.unique(np.concatenate([g.choice(frequent, 50), g.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)]))
    rare, at = voronoi_join.split_set(s, frequent, voronoi_join.slots(frequent))
    often = np.isin(s, frequent)
    assert rare.tolist() == s[~often].tolist() and frequent[at].tolist() == s[often].tolist()
    none = frequent[:0]
    assert voronoi_join.split_set(s, none, voronoi_join.slots(none))[0].tolist() == s.tolist()


def test_rounds_move_narrow_rows_and_drop_their_shuffles(spark, monkeypatch):
    """Rows of a round carry no lists of a point, its shuffle files go with its tables, and a round is few tables."""
    common.ship(spark)
    g = np.random.default_rng(5)
    phrases = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(12)]
    rows = [(k, " ".join([*(phrases[i] for i in g.choice(12, 6, replace=False)), f"own{k}"])) for k in range(120)]
    seen, plain = [], voronoi_join.written

    def watched(df, name, tidy=False):
        seen.append((name, set(df.columns), tidy))
        return plain(df, name, tidy)

    monkeypatch.setattr(voronoi_join, "written", watched)
    linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    moved = [columns for name, columns, _ in seen if name.startswith(("frequent-", "rare-")) and name.endswith(("-open", "-marked"))]
    assert moved and not any(columns & {"window", "sig", "s"} for columns in moved)
    assert all(tidy for name, _, tidy in seen if name != "points")
    rounds = sum(name.endswith("-marked") for name, _, _ in seen)
    assert sum(name in ("links", "near", "joined", "fewer-links") or name.endswith("-links") and name != "pair-links" for name, _, _ in seen) <= 3 * (rounds + 4)


def test_a_pivot_is_copied_as_often_as_needed(spark):
    """One copy of the set of a pivot that meets few points, more of one that meets many; each pair once."""
    sets = spark.createDataFrame([(k, 3, [1, 2, k + 10]) for k in range(600)], "x long, n long, s array<bigint>")
    asked = spark.createDataFrame([(k, 0) for k in range(1, 600)] + [(5, 4)], "x long, p long")
    got = voronoi_join.overlaps(asked, sets)
    assert sorted((r.x, r.p, r.common, r.union) for r in got.collect()) == sorted([(k, 0, 2, 4) for k in range(1, 600)] + [(5, 4, 2, 4)])
    copied = []
    plain = voronoi_join.F.sequence
    voronoi_join.F.sequence = lambda a, b: copied.append(b) or plain(a, b)
    try:
        voronoi_join.overlaps(asked, sets)
    finally:
        voronoi_join.F.sequence = plain
    few = spark.createDataFrame([(1,), (256,), (599,)], "k long")
    assert [r[0] for r in few.select(copied[0] + 1).collect()] == [1, 1, 3]


def test_links_are_turned_once_for_components(spark, monkeypatch):
    """Turning links both ways explodes no rows, and the turns of components read them from a table."""
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(0, 1)], "x long, y long")
    both = voronoi_join.both_ways(links)
    assert both.count() == 62 and "Generate" not in both._jdf.queryExecution().toString()
    made, plain = [], voronoi_join.both_ways
    monkeypatch.setattr(voronoi_join, "both_ways", lambda links: made.append(1) or plain(links))
    assert {r.label for r in components(links).collect()} == {0} and len(made) == 1
