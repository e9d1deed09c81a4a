"""Brute force, round trips and odd rows for every operator of the subpackage."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import decontam, html, jaccard, licenses, mixing, quality, sharding, substrings, tokens, toxicity
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, size int, shard string, tox_score int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, ties, copies, near copies and repeated rows; extra columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    long = words(rng, 20_000)
    texts = [None, "", "   \n\t ", "one", "one two three", "One TWO three", base, base, base + " tail", "head " + base, long, long + " end", "é" * 50, "a" * 900]
    texts += [words(rng, rng.randrange(60, 200)) for _ in range(20)]
    texts += [" ".join([w if rng.random() > 0.004 else "zz" for w in base.split()]) for _ in range(6)]
    out = [(k, t, None, None if k % 7 == 3 else f"s{k % 3}", None, "x", None, 1, "q", 2) for k, t in enumerate(texts)]
    return [*out, (None, base, None, "s1", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), out[20], out[20]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_jaccard_equals_all_pairs(docs, rows):
    sets = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(shingle_set(r[1]))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    want = sorted(((r[0], len(shingle_set(r[1])), None if r[0] is None else find(r[0])) for r in rows), key=str)
    assert got == want
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({find(i) for i in sets}) and kept.count(None) == 2
    assert sorted(map(str, jaccard.join(docs, exact=True).collect())) == sorted(map(str, jaccard.join(docs).collect()))
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_jaccard_cuts_large_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)  # every shared key is large
    rng = random.Random(5)
    shared = words(rng, 60, 10_000)
    texts = [words(rng, 40, 10_000) + " " + shared for _ in range(40)]
    texts += [t + " more" for t in texts[:10]]
    base = words(rng, 120, 10_000).split()
    texts += [" ".join(f"z{k}x{j}" if rng.random() < 0.02 else w for j, w in enumerate(base)) for k in range(60)]
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in jaccard.join(docs, exact=exact).collect()}
        assert got == {k: find(k) for k in range(len(texts))}


def test_jaccard_hot_passage_is_not_quadratic(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    real, shipped = jaccard._found, []

    def counting(tasks, bitmaps, every):
        shipped[-1] += tasks.count()
        return real(tasks, bitmaps, every)

    monkeypatch.setattr(jaccard, "_found", counting)
    rng = random.Random(17)
    passage = [f"p{k}" for k in range(200)]
    for n in (200, 800):
        own = [[f"o{d}x{k}" for k in range(rng.randrange(60, 240))] for d in range(n)]
        texts = [" ".join([*w[: d % 50], *passage, *w[d % 50 :]]) for d, w in enumerate(own)]
        texts += [texts[0] + " tail", "head " + texts[7]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        shipped.append(0)
        got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
        assert got == {k: {n: 0, n + 1: 7}.get(k, k) for k in range(n + 2)}
    # Four times the texts: at the power 1.2 at most, 5.3 times the rows.
    assert shipped[1] <= 5.3 * shipped[0]


def test_jaccard_near_copies_go_to_trees_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    real, shipped = jaccard._found, []

    def counting(tasks, bitmaps, every):
        shipped.append((every, tasks.count()))
        return real(tasks, bitmaps, every)

    monkeypatch.setattr(jaccard, "_found", counting)
    # Near copies about the threshold: some link, many do not, and all share most of their keys.
    rng = random.Random(23)
    base, n = words(rng, 150, 10_000).split(), 240
    texts = [" ".join(f"z{k}x{j}" if rng.random() < 0.022 else w for j, w in enumerate(base)) for k in range(n)]
    sets = [shingle_set(t) for t in texts]
    least = list(range(n))
    for a in range(n):
        for b in range(a):
            if least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((least[a], least[b]))
                least = [p if x == q else x for x in least]
    assert len(set(least)) > 20 and max(least.count(x) for x in set(least)) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == dict(enumerate(least))
    assert {every for every, _ in shipped} == {False, True}
    assert sum(rows for _, rows in shipped) <= 12 * n


def test_jaccard_ships_only_keys_that_are_searched(spark, monkeypatch):
    real, kept = jaccard._search, []

    def looking(every):
        run = real(every)

        def looked(batches):
            def seen():
                for b in batches:
                    keys = b.column("keys").to_pylist() if "keys" in b.schema.names else []
                    bad = [k for k, low in zip(b.column("key").to_pylist(), keys, strict=False) if any(x >= k for x in low)]
                    if bad or (keys and not every):
                        raise ValueError("keys that no one reads")
                    yield b

            yield from run(seen())

        kept.append(every)
        return looked

    monkeypatch.setattr(jaccard, "_search", looking)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    # 40 texts that quote one passage, and a pair beside each.
    passage = [f"p{k}" for k in range(60)]
    own = [[f"o{d}x{k}" for k in range(40)] for d in range(40)]
    texts = [" ".join([*passage, *w]) for w in own] + [" ".join([*passage, *w, "tail"]) for w in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {k: k % 40 for k in range(80)}
    assert False in kept and True in kept


def test_jaccard_links_come_from_trees(monkeypatch):
    rng = random.Random(7)
    texts = [words(rng, 80, 10_000) for _ in range(20)]
    raw = [(t + end).encode() for t in texts for end in ("", " more")]
    sets = jaccard._sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    bits = [jaccard.bitmap(s) for s in sets]
    assert jaccard.settled(sets, bits).tolist() == [k - k % 2 for k in range(40)]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(jaccard, "survivors", lambda *_: (none, none, none))
    assert jaccard.settled(sets, bits).tolist() == list(range(40))


def test_jaccard_ids_with_several_texts(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 120, 4):
        x, y = words(rng, 90, 10_000), words(rng, 90, 10_000)
        rows += [(k + 1, x), (k + 1, y), (k + 2, x + " more"), (k + 3, y + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {k + j: k + 1 for k in range(0, 120, 4) for j in (1, 2, 3)}
    kept = {(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()}
    assert kept == {r for r in rows if r[0] % 4 == 1}


def test_signature_trees_keep_every_linked_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        s = np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64))
        more = rng.integers(0, 2**63, len(s) // 8).astype(np.uint64)
        sets += [s, np.unique(np.concatenate([s, more]))]
    n = len(sets)
    home = np.arange(n) % 7
    a, b, _ = jaccard.survivors(np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets], np.arange(n), home)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(found) == len(a)
    want = {(j, i) for i in range(n) for j in range(i) if home[i] != home[j] and jaccard.linked(sets[i], sets[j])}
    assert want <= found and len(found) < n * (n - 1) / 4
    least = jaccard.settled(sets, [jaccard.bitmap(s) for s in sets])
    assert least.tolist() == [k - k % 2 for k in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (8, 8), (8, 7), *[(100 + k, 101 + k) for k in range(40)], *[(500, 501 + k) for k in range(30)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + k: 100 for k in range(41)} | {500 + k: 500 for k in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings_equals_counting(docs, rows):
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[j : j + 200] for t in texts for j in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        want.append((r[0], len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest(), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        merged = list(substrings.merge([substrings.front_code(r) for r in runs]))
        assert [m[2] for m in merged] == sorted(x for r in runs for x in r)
        assert all(runs[run][i] == x for run, i, x, _ in merged)
        for (_, _, x, _), (_, _, y, shared) in zip(merged, merged[1:]):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert shared == n


def test_quality_counts(docs, rows):
    for r in quality.quality(docs).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        w = WORD.findall(text or "")
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert (r.clean_text is not None) == r.kept


def test_quality_lines():
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))
    text = good + "\nHome | News | Sport | Help\nAll rights reserved.\n" + good.split("\n")[0] + "\nBUY!! NOW!! HERE!! TODAY!!\n### $$$ %%% a"
    out = quality.judge(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert out["kept"][0] and out["clean_text"][0].as_py() == good and out["n_dup_lines"][0] == 1
    assert out["n_symbols"][0] == 3 + 9


def test_quality_line_rules():
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))

    def left(*lines):
        raw = "\n".join([good, *lines]).encode()
        out = quality.judge(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return out["clean_text"][0].as_py().removeprefix(good).split("\n")[1:]

    assert left("Home", "About us", "Our news", "Contact") == []
    assert left("Home", "About us", "Contact") == ["Home", "About us", "Contact"]  # a run of three
    assert left("One.", "Two, ", "Three:", "Four!") == ["One.", "Two, ", "Three:", "Four!"]
    assert left("Home", "About us", "", "Our news", "Contact") == ["Home", "About us", "", "Our news", "Contact"]
    assert left("READ ALL OF THE LATEST OFFERS here") == [] and left("NATO and the EU met.") == ["NATO and the EU met."]
    # Runs end with a document.
    raw = [b"a\nb", b"c\nd"]
    assert quality.judge(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 3, 6]))["n_lost_words"].tolist() == [0, 0]


def test_sharding(docs, rows):
    out = sharding.rewritten(docs)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == {*docs.columns, "shard", "slot"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 40 for k, s in by.items())


def test_min_cost_flow_moves_the_least():
    rng = random.Random(4)
    for _ in range(20):
        supply = [rng.randrange(100) for _ in range(5)]
        capacity = sharding.even_capacities(sum(supply) + 9, 7)
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(5)] == supply
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= capacity[k] for k in range(7))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [1])


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert {r.source_size for r in got} == set(sizes.values())
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_tokens_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.common import scratch

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = tokens.write_ids(docs, scratch(docs.sparkSession, "t"), path)
    got = sorted(tokens.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = [*tokenizer.encode(next(x[1] for x in rows if x[0] == r.doc_id) or "", add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_encoder_equals_the_library_on_odd_spaces():
    import public_tokenizers

    encode = tokens.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", " ", " ", "\n", "\t", "\0", " ", "'s", "12", "é", ".", "<|endoftext|>"]) for _ in range(rng.randrange(20))) for _ in range(400)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_folder_without_a_scheme(spark, tmp_path):
    """A folder is resolved as Spark resolves its own paths, and a scheme that no file system serves is refused."""
    import public_tokenizers

    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    manifest = tokens.write_ids(rows, f"{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.path.startswith("file:/") for r in manifest.collect()) and tokens.read_ids(manifest).count() == 2
    assert tokens.qualified(spark, "hdfs://host/a") == "hdfs://host/a" and tokens._filesystem("file:/a/b")[1] == tokens._filesystem("file:///a/b")[1] == "/a/b"
    with pytest.raises(ValueError):
        tokens._filesystem("nowhere://a/b")


def test_token_file_reads_only_wanted_frames(tmp_path):
    writer = tokens.Writer(str(tmp_path))
    for k in range(30):
        writer.add(k, np.full(20_000, k, "<u4").tobytes())
    row = writer.close()
    file = tokens.Reader(row["path"])
    read = []
    whole = file.frame
    file.frame = lambda k: read.append(k) or whole(k)
    assert [(i, ids[:4]) for i, ids in file.documents([3, 25])] == [(3, b"\3\0\0\0"), (25, b"\x19\0\0\0")] and len(read) == 2
    raw = bytearray(open(row["path"], "rb").read())
    raw[5] ^= 255
    open(row["path"], "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        list(tokens.Reader(row["path"]).documents([0]))


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(6)
    bad = ["grok", "blarg", "snarf"]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 8 == 0
        w = words(rng, 60, 3000).split()
        if toxic:
            for b in bad:
                w[rng.randrange(60)] = b + rng.choice(["", ",", "er"])
        rows.append((k, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((k, int(toxic)))
    rows += [(None, None), (None, "grok blarg snarf"), (5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) > 0.95 * len(held)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.predicted == 0 for r in none)


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(9)
    items = [words(rng, n, 5000) for n in (3, 15, 15, 30, 59)]
    texts = [None, "", "x"] + [words(rng, 100, 5000) for _ in range(20)]
    for item in items:
        w = item.split()
        texts += ["pre " + item.upper() + " post", words(rng, 40, 5000) + " " + item, " ".join([*w[:-1], "other"]), " ".join(w[: len(w) // 2])]
    benchmark = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, item_id string, body int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs, benchmark).collect()}

    def weights(w):
        return collections.Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    want = {}
    for k, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        for i, item in enumerate(items):
            y = weights(WORD.findall(item))
            n = len(WORD.findall(item))
            best = 0
            for a in range(len(w) - n + 1):
                x = weights(w[a : a + n])
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best >= 0.75:
                want[k, i] = best
    assert got == pytest.approx(want) and len(want) >= 10
    assert got == pytest.approx({(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs, benchmark, exact=True).collect()})
    clean = decontam.clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {k for k, _ in want}


def test_decontamination_finds_shortened_copies(spark):
    rng = random.Random(11)
    items = [words(rng, n, 5000).split() for n in (5, 8, 15, 30, 59, 59)]
    texts = [w[a : len(w) - b] for w in items for a in range(4) for b in range(0, 16, 3) if len(w) > a + b]
    texts += [[*w[:20], *w[22:]] for w in items] + [["other", *w[2:-2]] for w in items] + [["x"] * 9 + w[:-3] for w in items]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in decontam.leaks(docs, benchmark).collect()}

    def weights(w):
        return collections.Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    want = {}
    for k, w in enumerate(texts):
        for i, item in enumerate(items):
            n, y = min(len(w), len(item)), weights(item)
            best = max(sum((x & y).values()) / sum((x | y).values()) for x in (weights(w[a : a + n]) for a in range(len(w) - n + 1)))
            if best >= 0.75:
                want[k, i] = (best, n)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sum(len(texts[k]) < len(items[i]) for k, i in want) >= 20
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == set(range(len(texts))) - {k for k, _ in want}


def test_exact_decontamination_needs_no_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(decontam, "_near_items", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rng = random.Random(21)
    item = words(rng, 40, 5000)
    raw = [f"{words(rng, 30, 5000)} {item} {words(rng, 30, 5000)}".encode(), words(rng, 90, 5000).encode()]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    items = decontam.Items([7], [item])
    assert decontam.find(items, data, offsets) == []
    assert decontam.find(items, data, offsets, exact=True) == [(0, 0, 1.0, 30, 40)]


def test_multi_index_finds_all_within_radius():
    items = decontam.Items([1, 2], ["a b c d e f g", "h i j k l m n"])
    rng = np.random.default_rng(0)
    for _ in range(50):
        flipped = np.unpackbits(items.prints[0].view(np.uint8))
        flipped[rng.choice(decontam.BITS, decontam.RADIUS, replace=False)] ^= 1
        blocks = np.packbits(flipped).view(np.uint16)
        assert any(np.unpackbits(items.near()[b, blocks[b]])[0] for b in range(decontam.BLOCKS))


def test_shared_folder(spark):
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(fake(master))
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_toxicity_never_learns_from_held_out_labels(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, 40, 2000) + (" grok blarg snarf" if k % 6 == 0 else "")) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, int(k % 6 == 0)) for k in range(900)]
    flipped = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in labels]
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
    assert score(labels) == score(flipped)


def test_sharding_laws(spark):
    rng = random.Random(13)
    texts = [words(rng, rng.randrange(1, 400)) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[5], texts[5], None])], "doc_id long, text string")
    got = sharding.rewritten(docs).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 16
    mean = sum(size.values()) / 40
    assert len(got) == 3003 and len(size) == 40 and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean


def test_licenses(spark):
    rng = random.Random(1)
    long = licenses.TEMPLATES[1][1]
    texts = [None, "", "one two", words(rng, 300), words(rng, 200) + ". Released under the MIT License. " + words(rng, 90), long, words(rng, 50) + "\n" + long.upper() + "\n" + words(rng, 5000), " ".join(long.split()[:12])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in [*enumerate(texts), (4, texts[4]), (None, texts[4])]], "doc_id long, text string, license int")
    got = {(r.doc_id, r.license): round(r.containment, 3) for r in licenses.scan(docs).collect()}
    assert got == {(4, "MIT"): 1.0, (None, "MIT"): 1.0, (5, "Apache-2.0"): 1.0, (6, "Apache-2.0"): 1.0, (7, "Apache-2.0"): 1.0}


@pytest.mark.parametrize("exact", [False, True])
def test_licenses_equal_all_windows(spark, exact):
    rng = random.Random(8)
    one, two = words(rng, 24, 5000), words(rng, 40, 5000)
    templates = [("A", one), ("B", two)]
    texts = []
    for t in (one, two):
        w = t.split()
        texts += [" ".join([words(rng, rng.randrange(90), 5000), *[x if rng.random() > p else "zz" for x in w], words(rng, 30, 5000)]) for p in (0, 0.01, 0.03, 0.05, 0.1) for _ in range(6)]
    texts += [" ".join(one + " " + words(rng, 9, 5000) for _ in range(2000)), words(rng, 400, 5000)]
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for k, t in enumerate(texts):
        g = gram(t.split())
        for name, template in templates:
            s = set(gram(template.split()))
            stride = len(s) // 4
            # The windows, but not how they are retrieved.
            best = max(len(s & set(g[a : a + len(s) + stride - 1])) / len(s) for a in range(0, len(g), stride))
            if best >= 0.75:
                want[k, name] = best
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(docs, templates=templates, exact=exact).collect()}
    assert got == pytest.approx(want) and 20 <= len(want) < 50


def test_licenses_tell_siblings_apart(spark):
    notice = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    clauses = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    name = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING'
    cases = {
        notice.format(";", "", 2): "GPL-2.0-or-later",
        notice.format(":", "", 3): "GPL-3.0-or-later",
        notice.format(":", "Affero ", 3): "AGPL-3.0-or-later",
        notice.format(";", "Lesser ", "2.1"): "LGPL-2.1-or-later",
        clauses + end: "BSD-2-Clause",
        clauses + name + end: "BSD-3-Clause",
        clauses[:140]: "BSD-2-Clause OR BSD-3-Clause",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3 or later.": "GPL-3.0-or-later",
        "Licensed under CC BY 3.0": "CC-BY-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
    }
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, f"{words(rng, 30)} {t} {words(rng, 30)}") for k, t in enumerate(cases)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect())
    assert got == list(enumerate(cases.values()))


PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body class="comments-open"><header>Site</header><nav><a href=/x>Home</a></nav>
<div class="cookie-notice">We use cookies, many of them, here.</div><main><article><h1>A &amp; B</h1><p>First   paragraph, with commas,<br>and a <a href="/y">link</a>.
<p>Second &lt;one&gt;, never closed<div><p>Third one, in a box, long enough to count.</p></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><form>Your mail</form></article></main>
<aside>Side</aside><div id="comments"><p>Nice article, really, I mean it.</p></div><footer>Foot</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "A & B\nFirst paragraph, with commas, and a link.\nSecond <one>, never closed\nThird one, in a box, long enough to count."
    for odd in ("", "<", "plain text", "<p", "<<<>>>", "<p>" * 5000, "<div>" * 3000 + "deep", "<!-- never closed", "<script>x", "a" * 500_000, '<a href="' * 2000):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("plain  text") == "plain text"
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_long_attributes():
    uri = "data:image/png;base64," + "iVBORw0KGgo+/" * 8000
    text = "A paragraph, with commas, long enough to count as one."
    for quote in "\"'":
        page = f"<body><article><p>{text}</p><img alt='it' src={quote}{uri}{quote}><p>{text} <b data-json={quote}{uri}{quote}>Bold</b>.</p><script data-x={quote}{uri}{quote}>var a = '<p>';</script></article></body>"
        assert html.main_text(page) == f"{text}\n{text} Bold."
    # Quotes that never close, stray ones, and ones in a script reach no further than their tag.
    assert html.main_text(f"<article><p title=it's>{text}</p><p>{text}</p></article>") == f"{text}\n{text}"
    assert html.main_text(f'<article><p title="open>{text}</p><p>{text}</p></article>') == f"{text}\n{text}"
    assert html.main_text(f"<article><script>w('<a href=\"' + u);</script><p>{text}</p><p id=\"x\">{text}</p></article>") == f"{text}\n{text}"
    assert html.main_text(f'<article><p>{text}</p><img src="{uri}" <p>{text}</p></article>') == f"{text}\n{text}"
    began = time.process_time()
    for odd in ("<a\" =\"", "<a ='\"", "<a x=\"", "<a", "<a x='\" y=\"'", "<a =", "<a b "):
        html.main_text(odd * 100_000)
    assert time.process_time() - began < 30


LINE = "This sentence is long enough, with commas, to count as a paragraph of text."
PART = f"<p>{LINE}</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><section>{PART * 8}</section><section><p>Short one.</p></section><section>{PART * 2}</section></main>", [LINE] * 8 + ["Short one."] + [LINE] * 2),
        (f"<div><section>{PART * 8}</section><section><h2>End</h2><p>Short one.</p></section></div>", [LINE] * 8 + ["End", "Short one."]),
        (f"<main><div>{PART * 4}</div><ul><li>one</li><li>two</li></ul><div>{PART}</div></main>", [*[LINE] * 4, "one", "two", LINE]),
        (f"<main><div>{PART * 4}</div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></main>", [LINE] * 4),
        (f"<article>{PART}<figure><pre>a = 1</pre><figcaption>Caption.</figcaption></figure>{PART}</article>", [LINE, "a = 1", "Caption.", LINE]),
        (f"<article>{PART}<figure><table><tr><td>1</td><td>2</td></tr></table></figure></article>", [LINE, "1", "2"]),
        (f"<article>{PART}<p>Given <math><mi>x</mi></math> it holds.</p></article>", [LINE, "Given x it holds."]),
        (f"<article>{PART}<p>Given <script>x</script>this <button>b</button>and <svg><path/></svg>that, <select><option>o</select>too.</p></article>", [LINE, "Given this and that, too."]),
    ],
)
def test_html_structures(page, want):
    assert html.main_text(f"<body><nav><a href=x>Home</a></nav>{page}<footer>Foot</footer></body>") == "\n".join(want)


@pytest.mark.parametrize("odd", ["<b>x</i>", "<span>x<hr>", "<li>x</li><span>", "<div><i>", "<b></p>", "<table><td><b>", "<dt>x</dd>", "<i><div><b></i>"])
def test_html_hostile_markup_takes_linear_time(odd):
    began = time.time()
    html.main_text(odd * ((1 << 20) // len(odd)))
    assert time.time() - began < 15


def test_html_names_and_forms():
    text = "A paragraph, with commas, long enough to count as one."
    body = f"<p>{text}</p><p>{text}</p>"
    for signs in ('style="overflow:hidden"', 'title="The hidden valley"', 'data-x="class=menu hidden"', 'class="overflow-hidden"', 'class="elementor-widget"', 'class="has-sidebar"', 'class="content-sidebar-wrap"'):
        assert html.main_text(f"<body><div {signs}><div>{body}</div></div><p>Scraps, of which there are more than enough.</p><p>More scraps, of which there are {'very ' * 40} many.</p></body>").startswith(text), signs
    # A form, or a container with a sign of its own, that holds most of the page is the article; its own small parts with signs still go.
    for tag in ("form", 'div class="sidebar"', 'div id="main-menu"'):
        name = tag.split()[0]
        assert html.main_text(f'<body><{tag}><div>{body * 3}<div class="ad"><p>{text} Buy.</p></div></div></{name}><div><p>Scraps, of which there are few.</p></div></body>') == "\n".join([text] * 6)
    # So are ten small ones that leave little without them.
    assert html.main_text("<body><div>" + f'<div class="widget"><p>{text}</p></div>' * 10 + "</div><h1>Title</h1></body>").count(text) == 10
    # Remarks are not the article however many; what is hidden, a menu or small stays away.
    for signs in ("hidden", 'hidden="hidden"', "aria-hidden=true", 'role="navigation"', 'class="x comments"', "id=comment-list"):
        assert html.main_text(f"<body><article>{body}</article><div {signs}>{body * 9}</div></body>") == f"{text}\n{text}", signs
    for signs in ('class="ad"', 'class="box cookie-notice"', "id=main-nav", 'class="site-header"'):
        assert html.main_text(f"<body><div>{body * 2}<div {signs}><p>{text} Extra.</p></div></div></body>") == "\n".join([text] * 4), signs
    assert html.main_text(f'<body><div class="comments">{body}</div></body>') == f"{text}\n{text}"
    assert html.main_text(f'<body><div class="ad"><p>{text}</p></div><article><h1>Short</h1><p>One.</p></article></body>') == "Short\nOne."


def test_html_skipped_elements_and_offsets():
    text = "A paragraph, with commas, long enough to count as one."
    article = f"<article><p>{text}</p><p>{text}</p></article>"
    want = f"{text}\n{text}"
    # Characters that change length when lower-cased move no offset.
    for odd in ("\u0130", "\u1e9e", "\ufb03", "\u0345", "\U0001f600"):
        assert html.main_text(f"<article><p>{text}</p><p>{odd * 40}</p><SCRIPT>x</Script ><p>{text}</p></article>") == f"{text}\n{odd * 40}\n{text}"
    for tag in ("template", "svg", "object"):
        inner = f"<p>Hidden, {text}</p>"
        assert html.main_text(f"<body>{article}<{tag}>{inner}<{tag} x=1>{inner}</{tag}>{inner}</{tag}></body>") == want, tag
        assert html.main_text(f"<body>{article}<{tag}>{inner}</body>") == want, tag
    for tag in ("script", "style", "textarea", "noscript", "iframe"):
        assert html.main_text(f"<body><{tag}>a <{tag}> b</{tag.upper()}>{article}</body>") == want, tag
        assert html.main_text(f"<body><{tag}>a </{tag}x> b</{tag}>{article}</body>") == want, tag
    assert html.main_text(f'<body><svg viewBox="0"/>{article}</body>') == want
    assert html.main_text(f"<body><div><div class=top><h1>Title</h1></div><div><p>{text}</p><p>{text}</p></div></div></body>") == f"Title\n{want}"
    for names in ("post has-comments", "container no-sidebar", "entry-content with-social", "layout-banner", "widgetized has-menu", "no-ads article"):
        for where in (f'<div class="{names}"><div>{article}</div></div>', f'<div id=x><div class="{names}">{article}</div></div>', f'<div><section id="{names.split()[0]}">{article}</section></div>'):
            assert html.main_text(f"<body>{where}</body>") == want, names


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, None), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 0, len(html.main_text(PAGE))] and all(len(r.text) == r.n_chars for r in got)


def test_empty_tables(spark, empty):
    assert jaccard.join(empty).count() == 0
    assert substrings.deduplicate(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    assert sharding.rewritten(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(empty, benchmark).count() == 0 and decontam.clean(empty, benchmark).count() == 0
    assert toxicity.clean(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    import public_tokenizers

    from tidemark.llm.common import scratch

    assert tokens.read_ids(tokens.write_ids(empty, scratch(spark, "none"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def written(spark, docs, labels, items):
    from tidemark.llm.common import scratch

    folder = scratch(spark, "sf")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_on_odd_rows(spark, docs, rows):
    import corpus_pipeline

    item = " ".join(rows[14][1].split()[:20])
    folder = written(spark, docs, [(14, 0, 1), *[(k, 1, 0) for k in range(15, 33)], (None, 1, 1)], [(1, item), (2, None)])
    now = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        held[name] = now.collect()
        if name != "sharding":
            assert now.columns == docs.columns, name
    assert {"doc_id", "text", "shard", "slot"} <= set(now.columns)
    # Each stage keeps what it has no reason to drop, judged on its own input.
    few, less = held["toxicity"], held["near_duplicates"]
    assert sum(r.text is None or not r.text.strip() for r in less) == sum(r.text is None or not r.text.strip() for r in few)
    assert {shingle_set(r.text) for r in less} <= {shingle_set(r.text) for r in few}
    assert {str(r) for r in held["decontamination"]} == {str(r) for r in less if item not in (r.text or "")}
    assert {str(r) for r in held["mixing"]} <= {str(r) for r in held["decontamination"]}
    assert len(held["sharding"]) == len(held["mixing"])


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, written(spark, empty, [], []))
    assert out.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)


def test_quality_keeps_scripts_without_spaces():
    lines = ["".join(chr(0x4E00 + (31 * k + 7 * j) % 900) for j in range(19)) for k in range(60)]
    judged = lambda text: quality.judge(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    for mark in ("。", "！", "…", "؟", ".", "”"):
        got = judged("\n".join(x + mark for x in lines))
        assert got["kept"][0] and got["n_lost_words"][0] == 0, mark
    assert judged("\n".join(x * 3 for x in lines))["kept"][0]  # long lines are no items of a menu
    assert not judged("\n".join(x[:4] for x in lines))["kept"][0]
