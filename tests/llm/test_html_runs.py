"""Repeated runs on pages with an article; copies of an article and shared passages of a host."""
import math
import random
from itertools import groupby
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skychan.llm import common, html_extract
from skychan.llm.html_extract import main_text


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def texts(spark, pages, **options):
    common.ship(spark)
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in main_text(df.repartition(3), **options).collect()}


def test_notice_within_articles(spark):
    share = words("share", 12)
    pages = [f"<body><nav>Home</nav><article><h1>Title {i}</h1><p>{words(f'own{i}x', 30)}</p><p>{share}</p></article></body>" for i in range(5)]
    for options in ({}, {"shard_tokens": 60}):
        got = texts(spark, pages, **options)
        assert all(got[i].text == f"Title {i}\n" + words(f"own{i}x", 30) and got[i].n_boilerplate == 1 for i in range(5))


def test_copies_and_shared_passage(spark):
    article, passage, menu = words("a", 60).split(), words("quoted", 20), words("menu", 10)
    near = [" ".join(article[:9 * k + 5] + [f"edit{k}"] + article[9 * k + 6:]) for k in range(5)]
    quoting = [f"{words(f'left{i}x', 15)} {passage} {words(f'right{i}x', 15)}" for i in range(2)]
    bodies = [*near, *quoting, words("other", 40)]
    for options in ({}, {"shard_tokens": 60}):
        for page in ("<body><div>{}</div><div>{}</div></body>", "<body><article><div>{}</div><div>{}</div></article></body>"):
            got = texts(spark, [page.format(menu, b) for b in bodies], **options)
            assert [got[i].text for i in range(8)] == bodies


def test_unique_part_of_a_block_stays(spark):
    notice = words("notice", 12)
    got = texts(spark, [f"<body><p>{notice} {words(f'own{i}x', 5)}</p><p>{words(f'more{i}x', 30)}</p></body>" for i in range(4)])
    assert all(got[i].text == words(f"own{i}x", 5) + "\n" + words(f"more{i}x", 30) for i in range(4))


def runs_by_hand(streams, length, need):
    """Of each page the tokens that lie in a run standing in at least ``need`` pages."""
    places = {}
    for i, s in enumerate(streams):
        for j in range(max(1, len(s) - length + 1)):
            places.setdefault(tuple(s[j:j + length]), set()).add(i)
    out = []
    for s in streams:
        covered = [False] * len(s)
        for j in range(max(1, len(s) - length + 1)):
            if len(places[tuple(s[j:j + length])]) >= need:
                covered[j:j + length] = [True] * len(s[j:j + length])
        out.append(covered)
    return out


def test_repeated_runs_by_brute_force(spark):
    """Random pages of one host that quote common lines: what stays, in one shard and in many, is what counting all runs leaves."""
    r = random.Random(3)
    common_lines = [words(f"line{i}x", r.choice((9, 12, 25))).split() for i in range(6)]
    pages = []
    for i in range(60):
        lines = [words(f"own{i}y{k}z", r.randint(3, 40)).split() for k in range(4)]
        for line in r.sample(common_lines, r.randint(0, 2)):
            k = r.randrange(len(lines))
            lines[k] = lines[k][:5] + line + lines[k][5:]
        pages.append(lines)
    need = max(3, math.ceil(math.sqrt(len(pages)) / 2))
    covered = runs_by_hand([[w for line in p for w in line] for p in pages], 8, need)
    expect = []
    for p, own in zip(pages, covered):
        at, text = 0, []
        for line in p:
            mine = own[at:at + len(line)]
            at += len(line)
            kept, j = [], 0
            for gone, run in groupby(mine):
                n = len(list(run))
                if not gone or (n < 8 and n < len(line)):
                    kept += line[j:j + n]
                j += n
            text.append(" ".join(kept))
        expect.append("\n".join(t for t in text if t))
    assert any(any(c) for c in covered)
    html = ["<body>" + "".join(f"<p>{' '.join(line)}</p>" for line in p) + "</body>" for p in pages]
    for shard_tokens in (1_000_000, 700):
        got = texts(spark, html, shard_tokens=shard_tokens, share=2.0)
        assert [got[i].text for i in range(len(pages))] == expect


def test_very_long_page(spark):
    """A page of 200,000 words is read whole, also when it is longer than a shard."""
    notice, long = words("notice", 12), words("long", 200_000)
    pages = [f"<body><p>{long}</p><p>{notice}</p></body>", *(f"<body><p>{words(f'own{i}x', 30)}</p><p>{notice}</p></body>" for i in range(4))]
    for options in ({}, {"shard_tokens": 5000}):
        got = texts(spark, pages, **options)
        assert got[0].text == long and got[0].n_chars == len(long) and got[3].text == words("own2x", 30)


def test_pages_are_stored_once(spark, tmp_path):
    """The table of parsed pages holds the texts, not their tokens beside them; the streams made from them are those that were counted."""
    common.ship(spark)
    r = random.Random(5)
    texts = [[" ".join(f"w{r.randrange(1 << 20)}é" for _ in range(120)) for _ in range(4)] for _ in range(200)] + [[]]
    html = ["<body><nav>Menu here</nav>" + "".join(f"<p>{t}</p>" for t in page) + "</body>" if page else None for page in texts]
    df = spark.createDataFrame([(i, "http://h.org/x", p) for i, p in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    table = html_extract.parsed(df)
    df.select(F.expr("replace(replace(html, '<p>'), '</p>')").alias("t")).coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/plain")
    size = lambda path: sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    assert size(table._written_to.removeprefix("file:")) < 1.4 * size(f"{tmp_path}/plain")
    for row in html_extract.streamed(table, "page_id long, page long, n_stream long, sizes binary").collect():
        assert xxhash.xxh3_64_intdigest(bytes(row.stream)) >> 1 == row.page and len(row.stream) == 4 * row.n_stream
        assert np.abs(np.frombuffer(row.sizes, "<i4")).sum() == row.n_stream


def test_shuffle_files_go_with_the_table(spark):
    """A table that is written leaves no shuffle files behind, and the session's own setting stays."""
    held = spark.conf.get(common.SHUFFLE_CLEANUP, None)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = html_extract.written(spark.range(1000).repartition(7, "id"), "shuffled")
    assert out.count() == 1000 and spark.conf.get(common.SHUFFLE_CLEANUP, None) == held
    assert tracker.shuffleStatuses().size() <= before + 1  # that of the count
