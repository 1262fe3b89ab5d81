"""Odd input: clashing names, texts of megabytes, alike rows; and learned features and scores against plain loops."""

import math
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import common, jaccard, mil, mixing, planes, rules, secrets, vectext
from tests.llm.test_operators import RANKS, WORD, awkward, frame, lower, near_rows, slowest_cost, vocabulary  # noqa: F401

M = (1 << 64) - 1
#: Names that operators use, or once used, for columns of their own.
NAMES = ["join_row", "stay", "mix_a", "mix_b", "mix_row", "mix_id", "mix_size", "mix_n", "mix_copy", "c_id", "c_a", "r", "copies", "row", "e", "label", "x", "held_out", "node", "component_id", "lm_row", "words"]


def clashing(spark, rows):
    """Documents whose other columns have the operators' names, each row with values of its own."""
    data = [(i, t, ("a", "b", None)[k % 3], *(f"{n}-{k}" for n in NAMES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def test_clashing_columns(spark, awkward):  # noqa: F811
    docs = clashing(spark, awkward + [(3, "again"), (None, "no id")])
    before = Counter(map(str, docs.collect()))
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(awkward)], "doc_id long, quality int")
    for out in (jaccard.one_of_each(docs), mil.accepted(docs, labels, steps=5)):
        assert out.columns == docs.columns and not Counter(map(str, out.collect())) - before
    masked = secrets.mask_documents(docs)
    assert masked.columns == docs.columns and Counter(map(str, masked.drop("text").collect())) == Counter(map(str, docs.drop("text").collect()))
    taken = Counter(map(str, mixing.mixed_documents(docs).collect()))
    assert set(taken) <= set(before) and max(taken.values()) <= 3
    assert mixing.mix(docs).count() == docs.count() and rules.judge(docs, labels).count() == docs.count()


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "same words here"), (None, "same words here"), (None, None), (None, ""), (7, "same words here")], "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter([(None, "same words here"), (None, None), (None, ""), (7, "same words here")])


def test_alike_rows_are_one_element(spark):
    rows = [(None, "five words are in here", "a")] * 4000 + [(1, "w " * 7, "a")] * 3000 + [(k, "w " * (1 + k % 9), "b") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and ((got["copies"] >= 0) & (got["copies"] <= 3)).all()
    by = got.groupby("source")
    assert (abs(by["taken"].sum() - by["target"].first()) <= 14).all()
    whole = mixing.mixed_documents(docs).groupBy(F.length("text").alias("n"), "source").count().toPandas()
    assert whole["count"].sum() == got["copies"].sum()
    packed = mixing._decide(docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("w"), F.xxhash64("text").alias("t"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), mixing.WEIGHTS, 3, 64, 17)
    assert packed.count() == 502


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def plain_hash(raw):
    total = 0
    for k, b in enumerate(raw):
        total += plain_mix(b + 0x51ED27) * pow(vectext.BASE, k, 1 << 64)
    return plain_mix((total + plain_mix(len(raw))) & M)


def slow_features(text):
    """One text's features by counting every n-gram."""
    words, chars = np.zeros(rules.WORD_BUCKETS), np.zeros(rules.CHAR_BUCKETS)
    h = [plain_hash(w.encode()) for w in WORD.findall(text)]
    for n in rules.WORD_ORDERS:
        for k in range(len(h) - n + 1):
            x = h[k]
            for y in h[k + 1 : k + n]:
                x = plain_mix((x * 0x9FB21C651E98DF25 + y) & M)
            words[(x >> 40) % rules.WORD_BUCKETS] += 1
    for n in rules.CHAR_ORDERS:
        for k in range(len(text) - n + 1):
            x = n
            for c in text[k : k + n]:
                x = ((x ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                x ^= x >> 15
            chars[(x >> 7) % rules.CHAR_BUCKETS] += 1
    return np.sqrt(np.concatenate([v / max(v.sum(), 1) for v in (words, chars)]))


def some_texts(awkward):  # noqa: F811
    return [(t or "")[:3000] for _, t in awkward]


def test_rule_features_by_counting(awkward, monkeypatch):  # noqa: F811
    texts = some_texts(awkward)
    want = np.stack([slow_features(t) for t in texts])
    assert np.allclose(rules.features(vectext.Words(pa.array(texts))), want, atol=1e-6)
    monkeypatch.setattr(rules, "STEP", 17)
    monkeypatch.setattr(vectext, "BLOCK", 61)
    assert np.allclose(rules.features(vectext.Words(pa.array(texts))), want, atol=1e-6)


def test_rule_verdicts_by_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").limit(150)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coef, bias = rules.learn(docs, labels, 40)
    got = {r["doc_id"]: r for r in rules.judge(docs, labels, 40).collect()}
    for i, t in rows:
        p = 1 / (1 + math.exp(-float(slow_features(t or "") @ coef + bias)))
        assert got[i]["probability"] == pytest.approx(p, abs=1e-4)
        if abs(p - rules.KEEP) > 1e-3:
            assert got[i]["kept"] == (not got[i]["base_failed"] and p >= rules.KEEP)


def slow_passages(text):
    """Features of each passage of one text, by loops."""
    raw = text.encode()
    spans = [m.span() for m in __import__("re").finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b] for a, b in spans]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    out = []
    for p in range(max(1, -(-len(words) // mil.PASSAGE))):
        own = range(p * mil.PASSAGE, min(len(words), (p + 1) * mil.PASSAGE))
        a = spans[own[0]][0] if p else 0
        b = spans[own[-1] + 1][0] if len(own) and own[-1] + 1 < len(words) else len(raw)
        part = raw[a:b]
        shape, grams = np.zeros(mil.N_SHAPE), np.zeros(mil.BUCKETS)
        for c in part:
            shape[mil.SHAPE[c]] += 1
        for k in range(a, b):
            if k + 1 < len(raw):
                grams[(((raw[k] | raw[k + 1] << 8) * 0x9E3779B1 & 0xFFFFFFFF) >> 9) % mil.BUCKETS] += 1
        seen, again = set(), 0
        for k in own:
            again += words[k] in seen
            seen.add(words[k])
        share = lambda n: n / max(len(own), 1)
        upper, letters = lambda w: sum(65 <= c <= 90 for c in w), lambda w: any(97 <= c <= 122 for c in w)
        stats = [
            share(sum(k > 0 and words[k] == words[k - 1] for k in own)), share(again), share(sum(k in hit for k in own)), share(sum(words[k][-1] in b"#*$%&|<>" for k in own)), share(sum(words[k][-1] == 33 for k in own)),
            share(sum(upper(words[k]) > 1 and not letters(words[k]) for k in own)), share(sum(len(words[k]) for k in own)) / 10, len(own) / mil.PASSAGE,
        ]
        size = max(len(part), 1)
        out.append(np.concatenate([np.sqrt(shape / size), stats, np.sqrt(grams / size)]))
    return np.array(out)


def slow_score(net, x):
    """Gated attention over one document's passages, one passage at a time."""
    p, sig = net.p, lambda v: 1 / (1 + np.exp(-v))
    h = [np.tanh(np.clip((row - net.mean) * net.scale, -6, 6) @ p["W"] + p["b"]) for row in x]
    s = np.array([float((np.tanh(v @ p["V"]) * sig(v @ p["U"])) @ p["w"]) for v in h])
    a = np.exp(s - s.max())
    z = sum(w * v for w, v in zip(a / a.sum(), h, strict=True))
    return float(sig(z @ p["c"] + p["d"][0]))


def test_mil_by_loops(spark, awkward, monkeypatch):  # noqa: F811
    monkeypatch.setattr(mil, "BLOCK", 97)
    texts = some_texts(awkward)
    for t in texts:  # alone, as a passage's last byte pair looks at the next text otherwise
        x, off = mil.passages(vectext.Words(pa.array([t])))
        want = slow_passages(t)
        assert off.tolist() == [0, len(want)] and np.allclose(x, want, atol=1e-5)
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(awkward)], "doc_id long, quality int")
    rows = [(k, t) for k, t in enumerate(texts)]
    net = mil.learn(frame(spark, rows), labels, steps=30)
    for t in texts:
        x, off = mil.passages(vectext.Words(pa.array([t])))
        assert net.scores(x, off)[0] == pytest.approx(slow_score(net, slow_passages(t)), abs=1e-4)


def test_passages_that_are_learned_from():
    assert mil.spread(3, 9, 16).tolist() == [3, 4, 5, 6, 7, 8]
    some = mil.spread(100, 1100, 16)
    assert len(some) == 16 and some[0] == 100 and 1030 < some[-1] < 1100 and len(set(np.diff(some))) <= 2


def slow_guess_spans(text):
    """As the module says, with every value cut out and scored anew."""
    found, covered = [], 0
    at = end = 0
    for c in secrets.CONTEXT.finditer(text):
        start = c.end()
        if start < covered and text[start] not in "\"'":
            continue
        if at <= start < end:
            first, stop = start, end
            first = at  # the value that the context lies in ends where it ended
            value = text[start:stop]
            begin = at
        else:
            m = secrets.VALUE.match(text, start)
            if not m:
                continue
            value = m[m.lastindex].rstrip(".,;:!?)") if m.lastindex == 3 else m[m.lastindex]
            begin = start = m.start(m.lastindex)
            stop = start + len(value)
            if m.lastindex == 3:
                at, end = begin, stop
        if stop > covered and stop - start >= secrets.GUESS_CHARS and slowest_cost(value) >= secrets.GUESS_MIN:
            found.append((begin, stop, "guess"))
            covered = stop
    return found


def test_added_spans_by_every_segmentation():
    r = random.Random(12)
    keys = ["password: ", "pwd=", "token: ", "the secret is ", "auth => ", "api_key:", "plain "]
    bits = ["qwerty", "2024", "0115", "aaaa", "abab", "Love", "h0use", "Xk9", "$mQ", "vLp", "12121999", "zebra", "-", "K7", "!"]
    for _ in range(150):
        t = " ".join(r.choice(keys) + r.choice(["", '"', "'"]) + "".join(r.choice(bits) for _ in range(r.randint(1, 5))) + r.choice(["", '"', ".", ","]) for _ in range(r.randint(1, 4)))
        assert secrets.guess_spans(t) == slow_guess_spans(t), t


def test_prose_stays_unmarked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.scan(docs).toPandas()
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for i, spans in zip(got["doc_id"], got["spans"], strict=True):
        for s in filter(None, spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "guess":  # no span of plain lower-case words
                assert not texts[i][int(a) : int(b)].replace(" ", "").islower() or any(c.isdigit() for c in texts[i][int(a) : int(b)])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_any_tokenizer(name):
    """The first drops white space, the second keeps it."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok, encode = Tokenizer.from_file(path), planes.word_encoder(path, 50)
    tok.encode_special_tokens = True
    r = random.Random(4)
    texts = ["the cat sat\non the mat", "", "  x \n\n y\t", "<|endoftext|> <|startoftext|>"]
    texts += ["".join(r.choice("abcthe sat\n\t  '.,09éÉ日🙂\x85\xa0<|>") for _ in range(r.randint(0, 30))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_block_hashes_and_code_points(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abé 日🙂\n") for _ in range(r.randint(0, 60))) for _ in range(100)] + ["x" * 500, ""]
    w = vectext.Words(pa.array(texts))
    whole = w.hashes(True)
    assert [plain_hash(lower(x).encode()) for t in texts for x in WORD.findall(t)] == whole.tolist()
    for block in (7, 64, 1000):
        assert (vectext.span_hashes(w.raw, w.starts, w.ends, True, block) == whole).all()
    monkeypatch.setattr(vectext, "BLOCK", 37)
    got = [[] for _ in texts]
    for points, own, mine in vectext.code_points(w.raw, w.text_off, 2):
        for c, i in zip(points[:mine], own[:mine], strict=True):
            got[i].append(chr(c))
    assert ["".join(g) for g in got] == texts
    marked = w.raw == ord("a")
    assert vectext.span_counts(marked, w.starts, w.ends, 5).tolist() == [int(marked[a:b].sum()) for a, b in zip(w.starts, w.ends, strict=True)]


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
from rangeloom.llm import bloomlm, jaccard, mil, rules, vectext
r = np.random.default_rng(1)
words = np.array([f"w{k}x" for k in range(50000)])
one = pa.array([" ".join(words[r.integers(0, len(words), 7_500_000)])])
size = one.nbytes
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
{"tokens": lambda: bloomlm.tokens(one), "sets": lambda: jaccard.shingle_sets(one), "counts": lambda: rules.base_counts(one),
 "features": lambda: rules.features(vectext.Words(one)), "passages": lambda: mil.passages(vectext.Words(one))}[sys.argv[1]]()
print(size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024 - before)
"""


@pytest.mark.parametrize("what", ["tokens", "sets", "counts", "features", "passages"])
def test_a_text_of_50_mb(what):
    """Every step takes a text of 50 MB, 7.5 million words, in bounded memory: at most 30 bytes a byte, not counting the text."""
    size, more = map(int, subprocess.run([sys.executable, "-c", LONG, what], capture_output=True, text=True, check=True).stdout.split()[-2:])
    assert size > 45e6 and more < 30 * size, f"{more / size:.1f} bytes a byte"


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2)], "ROW int, _row int")
    assert common.unused(df, "row", "row", "x") == ["__row", "___row", "x"]


def test_shuffle_files_end_with_their_plan(spark):
    with common.tidy(spark):
        assert spark.conf.get(common.TIDY) == "true"
    assert spark.conf.get(common.TIDY, None) in (None, "false")
