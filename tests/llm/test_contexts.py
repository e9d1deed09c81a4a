"""Context-tree weighting against a direct recursion, base scores against counts, odd rows, held-out code length."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import contexts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, bucket int, kind int, held_out string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def coded(text, depth):
    """(context, place, bit) of each decision of a text."""
    raw = b"\xff" * depth + lower(text).encode() + b"\xff"
    for i in range(depth, len(raw)):
        for bits in range(8):
            yield raw[i - depth : i], (bits, raw[i] >> (8 - bits)), (raw[i] >> (7 - bits)) & 1


def tree(texts, depth):
    count = collections.defaultdict(lambda: [0, 0])
    for text in texts:
        for context, place, bit in coded(text, depth):
            for d in range(depth + 1):
                count[context[depth - d :], place][bit] += 1
    kids = collections.defaultdict(list)
    for context, place in list(count):
        if context:
            kids[context[1:], place].append(context)

    def block(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    logs, share = {}, {}
    for context, place in sorted(count, key=lambda k: -len(k[0])):
        own = block(*count[context, place])
        if len(context) == depth:
            logs[context, place], share[context, place] = own, 1.0
        else:
            below = sum(logs[k, place] for k in kids[context, place])
            high = max(own, below)
            logs[context, place] = high + math.log(0.5 * math.exp(own - high) + 0.5 * math.exp(below - high))
            share[context, place] = math.exp(own + math.log(0.5) - logs[context, place])

    def given(context, place, bit, d=0):
        key = context[depth - d :], place
        if key not in count:
            return None if d else 0.5
        zeros, ones = count[key]
        own = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        deeper = given(context, place, bit, d + 1) if d < depth else None
        return own if deeper is None else share[key] * own + (1 - share[key]) * deeper

    return lambda text: sum(math.log10(given(*step)) for step in coded(text, depth))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts = [None, "", " \n", "A", "ab ab AB", "é" * 40, "a" * 500, "日本語の文。", "\u0000\u0001 x"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out = [(k, t, "en", None, 1, "i", None, 3, 4, "h") for k, t in enumerate(texts)]
    return [*out, (None, "ab cd", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), out[12], out[12]]


def want(rows, depth):
    learnt = [r[1] for r in rows if r[0] is None or r[0] % 4 != 1]
    count = collections.Counter()
    for text in learnt:
        count.update(WORD.findall(lower(text)))
        count[""] += 1  # the end
    n, v = sum(count.values()), len(count)
    score = tree(learnt, depth)
    out = []
    for r in rows:
        tokens = [*WORD.findall(lower(r[1])), ""]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((str(r[0]), r[0] is not None and r[0] % 4 == 1, len(tokens), sum(count[t] > 0 for t in tokens), n, base, score(r[1])))
    return sorted(out)


def held(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)


@pytest.mark.parametrize(("depth", "bucket"), [(3, 1 << 27), (4, 1 << 11), (6, 1 << 9)])
def test_scores_equal_the_recursion(spark, rows, depth, bucket):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = held(contexts.scores(docs, F.col("doc_id") % 4 == 1, depth=depth, bucket=bucket, group=1 << 10).collect())
    for a, b in zip(got, want(rows, depth), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_nothing_to_learn_from_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    some = contexts.scores(docs.where("doc_id = 4"), F.lit(True)).first()
    assert some.score == pytest.approx(-8 * 9 * math.log10(2), abs=1e-5) and (some.n_known, some.train_tokens) == (0, 0)
    assert contexts.scores(docs.limit(0), F.lit(False)).count() == 0


def test_held_out_texts_cost_less_than_under_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = contexts.scores(docs, F.col("doc_id") % 7 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes")).first()
    assert -both[0] / both[2] / math.log10(2) < 2.4  # bits a byte
    assert both[0] > 1.1 * both[1]


def test_large_counts_follow_the_gamma_function():
    import numpy as np

    for n in (1, 5, 65_535, 65_536, 10**7):
        assert contexts.log_factorial(np.array([n]))[0] == pytest.approx(math.lgamma(n + 1), rel=1e-12)
        assert contexts.log_halves(np.array([n]))[0] == pytest.approx(math.lgamma(n + 0.5) - math.lgamma(0.5), rel=1e-12)
