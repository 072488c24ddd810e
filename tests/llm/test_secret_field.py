"""The field finds secrets that no pattern announces; windows come from all places of a text."""
import random
import string

import pytest
from pyspark.sql import functions as F

from skychan.llm import common
from skychan.llm.crf_secrets import base_spans, digit_words, secrets, training_windows


def word(r):
    return "".join(r.choices(string.ascii_lowercase, k=r.randint(2, 10)))


def value(r):
    return "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(28, 40)))


@pytest.fixture(scope="module")
def corpus(spark):
    """Announced secrets to learn from, planted ones that no pattern fits, and numbers, dates, names that are none."""
    common.ship(spark)
    r = random.Random(11)
    rows, planted = [], {}
    for i in range(900):
        words = [word(r) for _ in range(60)] + [str(r.randint(0, 99999)), f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"Chapter{r.randint(1, 9)}"]
        r.shuffle(words)
        at = r.randint(5, 50)
        if i % 3 == 0:
            words[at:at] = [r.choice(["token", "api_key", "secret"]) + r.choice(["=", ": ", " = "]) + value(r)]
        elif i % 3 == 1:
            own = value(r)
            words[at:at] = [r.choice(["Bearer", "the password is", "private key", "use"]), own]
            planted[i] = own
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, planted


def test_precision_and_recall_of_unannounced_secrets(corpus):
    docs, rows, planted = corpus
    hit = wrong = 0
    texts = dict(rows)
    for r in secrets(docs).collect():
        for s in filter(None, r.spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "crf":
                found = texts[r.doc_id][int(a):int(b)]
                hit += found == planted.get(r.doc_id)
                wrong += found != planted.get(r.doc_id)
    assert all(not base_spans(texts[i]) for i in planted)
    assert hit / len(planted) >= 0.8, (hit, wrong, len(planted))
    assert hit / max(1, hit + wrong) >= 0.95, (hit, wrong)


def test_windows_of_all_places_whatever_the_partitions(spark, corpus):
    docs, rows, _ = corpus
    a, b = training_windows(docs, "text", 50), training_windows(docs.repartition(1), "text", 50)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert training_windows(docs.union(docs), "text", 50)[0].tolist() == a[0].tolist()  # copies change nothing
    r = random.Random(2)
    long_text = " ".join(x for _ in range(300) for x in (*(word(r) for _ in range(40)), "token=" + value(r)))
    x, y, _ = training_windows(spark.createDataFrame([(long_text,)], "text string"), "text", 1000)
    assert (y == 1).any(axis=1).sum() >= 250   # not just the first ones
    assert training_windows(docs.where(F.lit(False)), "text", 50)[0].shape[0] == 0


def test_digit_words():
    t = "ab 1 c2d,3 \t x\n9z 12"
    assert [t[a:b] for a, b in digit_words(t)] == ["1", "c2d,3", "9z", "12"]
    assert list(digit_words("")) == [] and list(digit_words("no digits")) == []
