"""Operators 11 to 13 against brute force: edge cases, hot groups, repeated rows, clashing columns."""
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skychan.llm import common
from skychan.llm.spelling import near_pairs, variants
from skychan.llm.url_cascade import cascade, hashed, holds, judged
from skychan.llm.whitening import whitened

LOW = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, least_count=2):
    count = {}
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= least_count}


def near(a, b):
    """Exactly one edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(count):
    out = {}
    of = {w: [o for o in count if abs(len(o) - len(w)) < 2 and near(w, o)] for w in count}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, count[w], len(of[w]), count[form[w]] if form[w] else None)
    return out


def same(df, rows, **options):
    got = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert got == brute_variants(brute_words(rows, **options))
    return got


@pytest.mark.parametrize("options", [{}, {"bucket": 1}, {"bucket": 1, "heavy": 3}])
def test_variants(spark, options):
    common.ship(spark)
    r = random.Random(5)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(7, 10))) for _ in range(12)]
    rows = []
    for i in range(60):
        out = []
        for w in base:
            for _ in range(r.choice([1, 1, 12])):
                k, x = r.randrange(len(w) + 1), r.choice("abcdxÿÀ")
                out.append(r.choice([w, w, w, w[:k] + x + w[k:], w[:k] + w[k + 1:], w[:k] + x + w[k + 1:], w.upper()]))
        rows.append((i if i % 7 else None, " ".join(out), "clash", 1, 2))
    rows += [(100, None, "x", 0, 0), (101, "", "x", 0, 0), (102, "short wörds ×÷× 12", "x", 0, 0), rows[3], rows[3],
             (103, "z" * 300 + " " + "z" * 300 + " " + "z" * 299 + " " + "z" * 299, "x", 0, 0)]  # a very long word
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, key int").repartition(4)
    got = same(variants(df, **options), [x[:2] for x in rows])
    assert any(v[1] for v in got.values()) and any(v[4] > 3 for v in got.values()) and "z" * 300 in got
    assert variants(df.filter("false"), **options).count() == 0


def test_hot_chunk(spark):
    """A third of all words begin alike: candidates stay in proportion to words and links."""
    r = random.Random(1)
    words = sorted({"commonhead" + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(1500)} | {"".join(r.choice("abcdefghij") for _ in range(12)) for _ in range(3000)})
    words += [w[:-1] for w in words[:50]] + [w[:12] + "z" + w[13:] for w in words[:50]]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = {tuple(sorted((x.u, x.v))) for x in near_pairs(table, bucket=64).collect()}
    by = {}
    for w in words:
        for i in range(len(w) + 1):
            by.setdefault((i, w[:i] + "*" + w[i + 1:] if i < len(w) else w + "*"), []).append(w)
            by.setdefault((w[:i] + w[i + 1:],), []).append(w)
            by.setdefault((w,), []).append(w)
    want = {tuple(sorted((a, b))) for k, g in by.items() if len(g) > 1 for a in g for b in g if a < b and near(a, b)}
    assert got == want and len(want) > 50


def test_long_forms(spark):
    """Roots follow several forms."""
    rows = [(1000 + i, " ".join(["abcdefghij"] * 2000 + ["abcdefghijk"] * 150 + ["abcdefghijkl"] * 12 + ["abcdefghijklm"])) for i in range(3)]
    got = same(variants(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert got["abcdefghijklm"][2] in ("abcdefghij", "abcdefghijk", "abcdefghijkl")


def brute_whitening(rows, k):
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    total = [sum(f[j] for f in fit) for j in range(d)]
    z = np.array([[float(Fraction(f[j]) - Fraction(total[j], n)) for j in range(d)] for f in fit])
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(r, total)] for r in x])
    return n, deviation, centred @ v / np.sqrt(e), e / np.trace(z.T @ z / n)


def test_whitening(spark):
    common.ship(spark)
    g = np.random.default_rng(3)
    x = (g.normal(size=(400, 20)) * np.geomspace(5, 0.2, 20)) @ np.linalg.qr(g.normal(size=(20, 20)))[0]
    x[5:9] = x[4]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype("f4"))]
    bad = [(900, None), (901, [None] + [0.0] * 19), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [1.0] * 3), (905, []), (906, [1e30] * 20)]
    clash = [(i, v, 1, 2, "x") for i, v in [*rows, rows[7], (None, rows[8][1]), *bad]]
    df = spark.createDataFrame(clash, "vec_id long, embedding array<float>, n long, component int, x string").repartition(5)
    got = whitened(df).collect()
    n, deviation, want, share = brute_whitening(rows, 16)
    assert len(got) == 402 * 16 and {r.n for r in got} == {n} == {396}
    own = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 17):
        mine = np.array([own[i, c].whitened for i in range(400)])
        assert min(np.abs(mine - want[:, c - 1]).max(), np.abs(mine + want[:, c - 1]).max()) < 1e-8
        assert abs(own[0, c].explained / share[c - 1] - 1) < 1e-9
    assert all(own[i, 1].deviation == deviation[i] for i in range(400)) and got[0].identity_error < 1e-10
    assert whitened(df.filter("false")).count() == 0 and whitened(df.filter("vec_id = 904 OR vec_id >= 905")).count() == 0


def test_whitening_of_dependent_columns(spark):
    """Nearly and fully dependent columns: the plain Gram matrix has no Cholesky factor; components are still right."""
    g = np.random.default_rng(4)
    big = g.normal(size=(300, 1)) * 2.0 ** 22  # against steps of 1 / 64: a condition number of about 1e8
    x = np.concatenate([big, big + g.integers(-3, 4, (300, 1)) / 64, g.normal(size=(300, 3)), np.zeros((300, 1))], 1)
    x = np.floor(x * 64) / 64
    got = whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and got[0].identity_error < 1e-6
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component)) if r.component == c] for c in range(1, 6)])
    assert np.abs(w @ w.T / 300 - np.eye(5)).max() < 1e-6
    y = np.array([[int(c) for c in row * 64] for row in x], object)
    z = (300 * y - y.sum(0)).astype(float) / 300
    u = z[:, 0] - z[:, 1]  # the variance along the nearly dependent direction is half of that of the difference
    small = sorted(got, key=lambda r: r.component)[-1].explained * (z ** 2).sum() / 300
    assert 0.3 < small / (u.var() / 2) < 1.5


def brute_rule(url, rules):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow")


URLS = ["http://a.example.net/en/x", "HTTPS://EXAMPLE.net/en", "http://net/", "http://net", "http://a.net?x=/", "http://xnet/", "x://y://z.net/p#q", "no url", "", None, "http://example.com/de/", "http://b.org/fr/1?2#3",
        "http://b.org:80/fr/1", "http://.net/x", "http://a..net/", "://net/", "http:///en/", "http://u@h.net/\n/x", "http://ÄB.Net/", "http://" + "a." * 50_000 + "net/" + "p" * 100_000]


@pytest.mark.parametrize("shard_keys", [8_000_000, 2])
def test_urls(spark, shard_keys):
    common.ship(spark)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    some = [*rules, ("b.org", "/f", "block"), ("net", "/p", "allow"), ("z.net", None, "block")]
    rows = [(i if i != 4 else None, u, "clash", "clash", 3) for i, u in enumerate(URLS)] + [(1, URLS[1], "", "", 0)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, found int").repartition(3)
    for use in (rules, some):
        given = spark.createDataFrame([*use, (None, "/", "block")], "host string, path string, verdict string")
        got = sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(pages, given, shard_keys=shard_keys).collect()]))
        plain = [(h, p or "", v) for h, p, v in use]
        assert got == sorted(map(str, [(i, *brute_rule(u, plain)) for i, u, *_ in rows]))
    assert judged(pages.filter("false"), given).count() == 0
    assert judged(pages, given.filter("false")).filter("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_cascade_is_exact(spark):
    """Many listed keys in a large universe: several levels, and none of the keys is misjudged."""
    listed = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    levels = cascade(listed, universe.union(universe))
    assert len(levels) > 3 and sum(len(x.words) for x in levels) * 64 < 8 * 20_000 + 20_000 * 4
    rows = universe.select("key", *hashed(F.col("key"))).toPandas()
    found = holds(levels, rows["a"].to_numpy(), rows["b"].to_numpy())
    assert (found == np.array([int(k[1:]) % 7 == 0 and int(k[1:]) < 140_000 for k in rows["key"]])).all()
    wrong = levels[0].has(rows["a"].to_numpy(), rows["b"].to_numpy(), 1) & ~found
    assert wrong.sum() > 0  # level 1 alone is not exact
    assert cascade(listed.filter("false"), universe) == []
