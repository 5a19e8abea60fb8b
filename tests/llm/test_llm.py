"""The corpus operators against brute force, on odd rows and on the small tables."""

import collections
import hashlib
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from siltline.llm import bpe, decontam, labelled, lm, pii, quality, rules, simhash, substring, toxicity, warc
from siltline.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(params=["odd_docs", "no_docs", "table"])
def docs(request, spark, sf_dir):
    return table(spark, sf_dir, "documents") if request.param == "table" else request.getfixturevalue(request.param)


# WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/\r\nx", big), (5, "u", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (7, "u", None), (8, "u", other), (8, "u", other), (None, "u", other), (9, "u", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "resp", 1) for r in rows], "page_id long, url string, html string, kind string, digest int")
    made = warc.write(pages, f"file://{tmp_path}/a")
    found = warc.read(made).collect()
    newest = {big: 5, other: 8}
    expected = []
    for i, _, t in rows:
        data = (t or "").encode()
        kind, to = ("response", None) if t not in newest or i == newest[t] else ("revisit", newest[t])
        expected.append((i, kind, len(data), hashlib.sha1(data).hexdigest(), to, data if kind == "response" else None))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["page_id"], r["kind"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in found), key=key) == sorted(expected, key=key)
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_warc_archive_opens_with_its_dictionary():
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    data = [warc.record(i, "u", (f"<p>page {i} of many</p>" * 9).encode(), "00" * 20, "response", None) for i in range(900)]
    for x in data:
        writer.add(x)
    writer.close()
    out.seek(0)
    assert out.read(4) == (0x184D2A5D).to_bytes(4, "little")
    out.seek(0)
    assert list(warc.frames(out, 100)) == data
    with pytest.raises(ValueError):
        warc.parsed(data[0])


# personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0]))


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(4)
    alphabet = ["a", "@", ".", "-", " ", "+", "1", "2", "55", "300", "4111111111111111", "(", ")", "é", "x.com", "%", "10.0.0.1", "+1 (555) 010-9999"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
        assert pii.joined([s for s in pii.find(text) if s.kind in pii.BASE]) == base_spans(text), text


def test_pii_rows(docs):
    found = sorted(((r["id"], r["base"]) for r in pii.spans_of(docs).collect()), key=str)
    assert found == sorted(((i, base_spans(t)) for i, t in pairs(docs)), key=str)


def test_pii_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.find(t)]
    assert kinds("to GB82 WEST 1234 5698 7654 32 now") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("to GB83 WEST 1234 5698 7654 32 now") == []
    assert kinds("ssn 123-45-6789") == [("id", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert pii.masked("write a.b@c.de or 10.0.0.1!") == "write <email> or <ip>!"
    assert len(pii.find("1" * 200_000 + "." * 100_000 + "a" * 200_000)) == 0


# decontamination


def test_decontamination_finds_every_window(spark, sf_dir, odd_docs):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    rng = random.Random(8)
    leaks = []
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        if k % 3 == 0 and len(w) > 30:
            del w[-1]  # near copies keep most shingles
        leaks.append((10_000 + k, " ".join([*rng.choices("abc", k=k), *w, "tail"])))
    items += [(900, None), (901, ""), (902, "one two"), (903, items[0][1]), (None, "null id")]
    docs = docs.unionByName(spark.createDataFrame([*leaks, (11_000, "ONE, two")], "doc_id long, text string"))
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id int")

    def plain(text):
        at, w = decontam.plain_words(pa.array([text], pa.string()))
        return w.to_pylist()

    def bag(w):
        n = min(5, len(w))
        return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    distinct = {}
    for i, t in items:
        if i is not None and plain(t):
            distinct[tuple(plain(t))] = min(i, distinct.get(tuple(plain(t)), i))
    expected = set()
    for key, text in pairs(docs):
        w = plain(text)
        have = set(w)
        for item, i in distinct.items():
            if len(have & set(item)) * 2 < len(set(item)):
                continue
            size = min(len(item), len(w))
            target = bag(item)
            for s in range(len(w) - size + 1):
                n = min(5, len(item))
                window = w[s : s + size]
                grams = collections.Counter(tuple(window[j : j + n]) for j in range(len(window) - n + 1))
                both = sum((grams & target).values())
                if both and both / (grams.total() + target.total() - both) >= 0.8:
                    expected.add((key, i))
                    break
    found = {(r["id"], m["item_id"]) for r in decontam.contaminated(docs, benchmark).collect() for m in r["matches"]}
    assert found == expected and {k for k, _ in found} >= {10_001, 10_002, 11_000}
    assert decontam.without_matches(docs, benchmark).where(F.col("doc_id").isin([k for k, _ in expected])).count() == 0
    assert decontam.without_matches(docs, benchmark.limit(0)).count() == docs.count()
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0


def test_decontamination_is_alike_in_any_blocks(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(8, 30)))) for k in range(12)]
    items += [(100 + k, t.upper().replace(" ", ",  ") + "!") for k, t in items]
    docs = [(k, " ".join(["lead", *(items[i][1] for i in rng.sample(range(12), 4)), "tail"])) for k in range(8)]
    docs += [docs[0], (None, items[3][1] + " " + items[5][1]), (50, "nothing alike")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(((r["id"], [tuple(m) for m in r["matches"]]) for r in df.collect()), key=str)
    whole = rows(decontam.contaminated(docs, benchmark))
    assert len(whole) == 10 and all(len(m) >= 2 and max(x[0] for x in m) < 12 for _, m in whole)
    assert len(decontam.item_blocks(benchmark, block_bytes=400)) > 3
    assert rows(decontam.contaminated(docs, benchmark, block_bytes=400)) == whole


def test_decontamination_of_repeats(spark):
    """Shingles that repeat widen the angle of fingerprints beyond any radius; such windows and items are found too."""
    rng = random.Random(3)
    items = [(1, "a b a b a b a b a b a b a"), (2, " ".join(f"w{i}" for i in range(104))), (3, "x " * 30), (4, " ".join(f"v{i}" for i in range(40)))]
    plain = items[1][1].split()
    texts = ["b a b a b a b a b a b a b", " ".join([*plain[:92], *([plain[91]] * 12)]), "x " * 27, " ".join([*items[3][1].split()[:37], "v36 v36 v36"]), "a b a b c"]
    texts += [" ".join(rng.choices(["a", "b"], weights=[3, 2], k=60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = set()
    for key, text in enumerate(texts):
        w = text.split()
        for i, t in items:
            item = t.split()
            n, size = min(5, len(item)), min(len(item), len(w))
            bag = lambda x: collections.Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))  # noqa: B023, E731
            target = bag(item)
            for s in range(len(w) - size + 1):
                window = bag(w[s : s + size])
                both = (window & target).total()
                if both and both / (window.total() + target.total() - both) >= 0.8:
                    expected.add((key, i))
                    break
    found = {(r["id"], m["item_id"]) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect() for m in r["matches"]}
    assert found == expected and (0, 1) in found


def test_decontamination_finds_items_without_an_id(spark, tmp_path):
    from siltline.llm.queries import op3_decontamination

    one, two, three = (" ".join(f"{c}{i}" for i in range(9)) for c in "abc")
    spark.createDataFrame([(1, f"x {one} y"), (2, f"{two} {three} {one}"), (3, "clean")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, one), (None, two), (None, three), (7, three.upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = op3_decontamination(spark, str(tmp_path)).select("doc_id", "n_items", "item_ids").collect()
    assert sorted(map(tuple, found)) == [(1, 1, "null"), (2, 3, "null,null,7")]
    docs, items = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "benchmark")
    assert [r["doc_id"] for r in decontam.without_matches(docs, items).collect()] == [3]
    rows = lambda df: sorted(((r["id"], [tuple(m) for m in r["matches"]]) for r in df.collect()), key=str)
    assert rows(decontam.contaminated(docs, items)) == rows(decontam.contaminated(docs, items, block_bytes=50))


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, (200, decontam.LANES), dtype=np.uint64)
    index = decontam.MultiIndex(prints)
    for k in range(60):
        one = prints[k].copy()
        for bit in rng.choice(256, size=k + 10, replace=False):
            one[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        far = np.bitwise_count(prints ^ one).sum(1)
        assert index.lookup(one) == [(int(i), int(far[i])) for i in np.flatnonzero(far <= decontam.RADIUS)]


# BPE


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(reference):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", " ", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "ab" * 4000, "é" * 3000, " \n" * 2000, "!?" * 3000 + " ok", "\n\n" + "7" * 4000 + "\n\nword", "don't we'll" * 300, "😀" * 2000]
    letters = "abcdefghijklmnopqrstuvwxyzABC éüß漢字😀'\n\t 0123456789.,!<|>"
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 400))) for _ in range(400)]
    texts += ["".join(rng.choices("abcdeinorst", k=rng.randrange(1100, 6000))) for _ in range(20)]
    texts += ["a  \n\n" + "".join(rng.choices("etaoin", k=2000)) + "\n \n b" + "#" * 1500 + "  c"]
    for text in texts:
        expected = reference.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert ids.tolist() == expected, text[:80]
        assert codec.decode(ids) == reference.decode(expected, skip_special_tokens=False) == text


def test_bpe_tree_of_any_cut(monkeypatch, reference):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    for leaf in (1, 2, 3, 7):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        for _ in range(60):
            text = "".join(rng.choices("ethanoisr", k=rng.randrange(1, 200)))
            assert codec.tree(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_bpe_rows(docs, reference):
    path = public_tokenizers.path("byte_bpe_50k.json")
    some = docs.limit(150)
    found = sorted(((r["id"], r["ids"], r["decoded"]) for r in bpe.encoded(some, path).collect()), key=str)
    assert found == sorted(((i, reference.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in pairs(some)), key=str)
    stored = bpe.stored(some, path)
    assert stored.columns[: len(docs.columns)] == docs.columns and stored.count() == some.count()


# language model


def unigram(texts, learnt):
    counts = collections.Counter(itertools.chain.from_iterable([*words(lowered(t)), " "] for t, ok in zip(texts, learnt, strict=True) if ok))
    return counts, sum(counts.values()), len(counts)


@pytest.mark.parametrize("sizes", [(lm.SLICE, lm.PART_BYTES), (3000, 20_000)])
def test_lm_rows_equal_the_definition(docs, sizes):
    """Counts, base and score by dictionaries over all training texts; slices and parts of any size give the same."""
    rows = [(i, t, i is None or zlib.crc32(str(i).encode()) % 7 != 2) for i, t in pairs(docs)]
    counts, total, distinct = unigram([t for _, t, _ in rows], [ok for *_, ok in rows])
    longer = collections.Counter()
    for _, t, ok in rows:
        if ok:
            led = [" ", *words(lowered(t)), " "]
            longer.update(tuple(led[i : i + n]) for n in (2, 3) for i in range(len(led) - n + 1))

    def p(history, w):
        if not history:
            return (counts[w] + 1) / (total + distinct + 1)
        k = lm.KAPPA[len(history) - 1]
        held = counts[history[0]] if len(history) == 1 else longer[history]
        return (longer[(*history, w)] + k * p(history[1:], w)) / (held + k)

    expected = []
    for i, t, ok in rows:
        w = [*words(lowered(t)), " "]
        led = [" ", *w]
        score = sum(math.log10(p(tuple(led[max(0, k - 1) : k + 1]), x)) for k, x in enumerate(w))
        expected.append((str(i), ok, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10(p((), x)) for x in w), 6), score))
    found = lm.BackoffScorer(slice_bytes=sizes[0], part_bytes=sizes[1]).score(docs, ~lm.held_out("doc_id", 7, 2)).collect()
    found = sorted((str(r["id"]), r["learnt"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in found)
    assert len(found) == len(expected)
    for f, e in zip(found, sorted(expected), strict=True):
        assert f[:6] == e[:6] and abs(f[6] - e[6]) < 1e-7 * max(1, abs(e[6]))


def test_lm_automaton_is_a_distribution():
    """For each context the probabilities of all words, and of one unseen word for the rest, add up to one."""
    grams = lm.Grams(pa.array(["a b c", "a b b", "b c", "c a b c", "a a a"]))
    counts = grams.counts(np.ones(5, bool))
    tokens, distinct = int(counts[0].sum()), int((counts[0] > 0).sum())
    known = [dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in zip(grams.keys, counts, strict=True)]

    def score(text):
        own = lm.Grams(pa.array([text]))
        model = lm.build(own, [np.array([known[o].get(x, 0) for x in k.tolist()], np.int64) for o, k in enumerate(own.keys)], tokens, distinct)
        # without the end, whose own cost is that of the text less that of its words
        ends = np.array([own.ends[0] - 1])
        return model.traverse(ends)[0], model.traverse(own.ends)[0] - model.traverse(ends)[0]

    for history in ["", "a", "b", "c", "a b", "b c", "c a", "c c", "a b c", "a zz"]:
        before = score(history)[0] if history else 0.0
        after = [score(f"{history} {w}".strip())[0] - before for w in ("a", "b", "c", "unseen")]
        assert abs(sum(10**x for x in [*after, score(history)[1] if history else score("")[1]]) - 1) < 1e-9


def test_lm_learns_more_than_unigrams(spark):
    """Held-out texts are likelier under the automaton than under its unigrams."""
    found = lm.BackoffScorer().score(table(spark, "/root/testdata/sf0.01", "documents"), ~lm.held_out("doc_id", 7, 2))
    held = found.where(~F.col("learnt")).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.3


def test_lm_traverse_in_step_equals_one_by_one(monkeypatch, spark, sf_dir):
    texts = table(spark, sf_dir, "documents").toArrow().column("text").combine_chunks()
    grams = lm.Grams(texts)
    counts = grams.counts(np.arange(len(texts)) % 3 > 0)
    model = lm.build(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()))
    found = []
    for few in (0, 16, 1 << 30):
        monkeypatch.setattr(lm, "FEW", few)
        found.append(model.traverse(grams.ends))
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


# toxicity and quality


def test_toxicity_learns_words_and_their_misspellings():
    rng = random.Random(9)
    clean = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("tar", "rin", "sol") for c in ("a", "en", "is", "or")]
    bad = ["stupid", "idiotic", "moronic"]
    texts, y = [], []
    for k in range(900):
        w = rng.choices(clean, k=rng.randrange(5, 80))
        if k % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(int(k % 3 == 0))
    model = toxicity.train(pa.array(texts[:700]), np.array(y[:700]))
    score = model.score(pa.array(texts[700:]))
    assert ((score >= 0.5) == np.array(y[700:])).mean() > 0.98
    odd = model.score(pa.array(["katara sstupid losolen", "katara stupiid", "katara losolen", "", None]))
    assert (odd[:2] > 0.5).all() and (odd[2:] < 0.5).all()
    assert toxicity.train(pa.array([], pa.string()), np.zeros(0, np.int64)).score(pa.array(["x"])).tolist() == [0.0]


def test_toxicity_rows(docs, spark, sf_dir):
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~lm.held_out("doc_id", 5, 0))
    found = toxicity.scored(docs, model)
    assert found.count() == docs.count() and set(found.columns) == {*docs.columns, "score"}
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_score_is_the_softmax_of_averaged_embeddings():
    """The margins of a model against embeddings averaged over each passage's bag, one passage at a time."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "betas", "gam", "foul", "Ünï", "x"], k=k)) for k in (1, 2, 4, 5, 6, 30, 0)] + [None]
    trainer = toxicity._Trainer(pa.array(["alpha", "foul"]))
    model = toxicity.ToxicityModel(*trainer.margins())
    embed, linear, bias = trainer.params
    for text, score in zip(texts, model.score(pa.array(texts)), strict=True):
        w, best = words(text), 0.0
        for i in range(max(1, len(w) - toxicity.WINDOW + 1) if w else 0):
            buckets, _ = toxicity.bags(pa.array(w[i : i + toxicity.WINDOW]))
            logits = embed[buckets].mean(0) @ linear + bias
            best = max(best, float(np.exp(logits[1]) / np.exp(logits).sum()))
        assert abs(score - best) < 1e-5


def test_toxicity_and_quality_on_held_out_rows(spark):
    """Rows whose ids are not learnt from: bounds on accuracy and on the order of scores, and the columns of the queries."""
    from siltline.llm.queries import op6_toxicity, op9_quality_classifier

    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in table(spark, sf, "labels").collect()}
    for rows, label in ((op6_toxicity(spark, sf).collect(), "toxic"), (op9_quality_classifier(spark, sf).collect(), "quality")):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert len(rows) == table(spark, sf, "documents").count()
        held = [(r, labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
        score = "score" if label == "toxic" else "tail_probability"
        good, bad = ([r[score] for r, y in held if y == k] for k in (1, 0))
        assert len(good) > 20 and len(bad) > 20
        auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
        assert auc > 0.95, (label, auc)
        if label == "toxic":
            assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
            assert sum(r["predicted"] == y for r, y in held) / len(held) > 0.96


def test_labelled_sample_passes_over_texts_that_do_not_fit(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    first = labels.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 2000)).otherwise(F.col("text")))
    texts, grades = labelled.sample(docs, labels, "toxic", F.lit(True), max_bytes=1000)
    assert sorted(texts.to_pylist()) == sorted(f"text {k}" for k in range(40) if k != first) and set(grades.tolist()) == {0, 1}
    with pytest.raises(ValueError, match="grades"):
        labelled.sample(docs, spark.range(65).selectExpr("id AS doc_id", "CAST(id AS int) AS toxic"), "toxic", F.lit(True))


def test_ordinal_grades_keep_their_order():
    rng = random.Random(1)
    pool = [["zz###", "q$$$"], ["plain", "middling"], ["lucid", "careful", "worked"]]
    texts, grades = [], []
    for k in range(900):
        g = k % 3
        texts.append(" ".join(rng.choices(pool[g], k=8) + rng.choices(["the", "of", "and"], k=12)))
        grades.append(g + 1)
    model = quality.train(pa.array(texts[:700]), np.array(grades[:700]))
    tails = model.tails(pa.array(texts[700:]))
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    assert (np.abs(model.expected(tails) - np.array(grades[700:])) < 0.5).mean() > 0.95
    assert quality.train(pa.array(["a"]), np.array([1])).expected(np.zeros((1, 0))).tolist() == [1.0]


def test_quality_rows(docs, spark, sf_dir):
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    found = quality.graded(docs, model)
    assert found.count() == docs.count() and found.where("tail_probability IS NULL OR kept IS NULL").count() == 0


# near duplicates


def brute_print(text):
    w = words(lowered(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    group = {p: p for p in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 3:
            group[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_groups(docs):
    rows = [(i, brute_print(t)) for i, t in pairs(docs)]
    group = brute_groups({p for _, p in rows})
    least = {}
    for i, p in rows:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    expected = sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in rows), key=str)
    found = simhash.near_duplicates(docs)
    assert sorted((tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()), key=str) == expected


def brute_sets(texts, shingle=5):
    out = []
    for t in texts:
        w = words(lowered(t))
        n = min(shingle, len(w))
        out.append(frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    return out


def brute_kept(rows, similarity=0.8):
    """Ids that stay of (id, text) rows: pairs by an index of all shingles, components, the least id of each."""
    sets = brute_sets([t for _, t in rows])
    group = {s: s for s in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    index = collections.defaultdict(list)
    for s in group:
        for g in s:
            index[g].append(s)
    for s in list(group):
        shared = collections.Counter(id(o) for g in s for o in index[g])
        names = {id(o): o for g in s for o in index[g]}
        for k, n in shared.items():
            o = names[k]
            if o is not s and n / (len(s) + len(o) - n) >= similarity - 1e-12:
                group[find(s)] = find(o)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        least.setdefault(find(s), []).append(i)
    return sorted((min((x for x in v if x is not None), default=None) for v in least.values()), key=str)


def near_copies(seed, n=40):
    """Rows (id, text): families of edited copies, copies, passages that many texts share, short texts."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = fresh(60), []
    for _ in range(n):
        base = fresh(rng.choice([1, 3, 6, 9, 30, 150, 400]))
        if rng.random() < 0.5:
            base[rng.randrange(len(base)) : 0] = passage
        rows.append(base)
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(rng.choice([base, rows[-1]]))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randrange(0, 2)] = fresh(rng.randrange(0, 2))
            rows.append(copy)
    rng.shuffle(rows)
    return [(k, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)) for k, w in enumerate(rows)]


def test_keep_one_of_near_duplicates(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == brute_kept(pairs(docs))


@pytest.mark.parametrize(("seed", "block", "hot"), [(0, 4096, 4096), (1, 8, 6), (2, 4096, 3), (3, 16, 4096)])
def test_keep_one_loses_no_link(spark, monkeypatch, seed, block, hot):
    rows = near_copies(seed)
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 5)
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, row__ long, print__ string").repartition(3)
    kept = simhash.keep_one(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute_kept(rows)
    assert kept.where("row__ != doc_id OR print__ != 'x'").count() == 0 and kept.columns == docs.columns


def test_wide_fingerprints_within_the_radius():
    """Sets at the similarity, of every size, lie within the radius and pass the ring of lanes."""
    rng = np.random.default_rng(2)
    for size in [1, 2, 4, 5, 8, 9, 10, 13, 17, 45, 100, 500]:
        for _ in range(300):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = rng.integers(0, size // 9 + 1)
            more = rng.integers(0, max(1, int(size / 0.8) - size + 1)) if not gone else gone
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            if simhash.jaccard(np.sort(a), [np.sort(b)])[0] >= 0.8:
                one, two = simhash.wide_simhash(a), simhash.wide_simhash(b)
                assert simhash.near(one, len(a), two[None], np.array([len(b)]), 0.8)[0]


@pytest.mark.parametrize("block", [4096, 16])
def test_simhash_links_lose_no_component(spark, monkeypatch, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(rng.choice([1, 1, 2, 30])):
            prints.add(p := p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints_df = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(sorted(prints))], "id long, fp long")
    ids = {signed(p): k for k, p in enumerate(sorted(prints))}
    group = brute_groups(prints)
    least = collections.defaultdict(lambda: 1 << 60)
    for p, g in group.items():
        least[g] = min(least[g], ids[signed(p)])
    found = {r["fp"]: r["component_id"] for r in simhash.components(prints_df).collect()}
    assert found == {signed(p): least[g] for p, g in group.items()}


def test_simhash_ring_guarantee():
    rng = random.Random(0)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        starts = [i for i in range(8) if simhash._within(np.uint64(0), np.array([differ], np.uint64), i)[0]]
        assert starts
        turned = lambda i: (differ << 8 * i | differ >> 64 - 8 * i) & (1 << 64) - 1
        assert any(turned(i) >> 36 == 0 or (turned(i) >> 48 == 0 and turned(i) >> 24 & 4095 == 0) for i in starts)


# substrings


def brute_removed(rows, window):
    places = collections.defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((k, i))
    gone = collections.defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + window))
    return [(i, len(words(t)), len(gone[k]), " ".join(x for j, x in enumerate(words(t)) if j not in gone[k])) for k, (i, t) in enumerate(rows)]


def same_removed(docs, window=35):
    found = substring.SubstringDedup(window).run_on(docs).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=str) == sorted(brute_removed(pairs(docs), window), key=str)


def test_substrings(docs):
    same_removed(docs)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_mixed_passages(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(20, 90))] for k in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, len(p))] if rng.random() < 0.7 else [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.1:
                w += ["loop", "of"] * rng.randrange(1, 40)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from siltline.session import cut

    same_removed(cut(df))


# quality rules


def test_rules_base_features(docs):
    expected = []
    for i, t in pairs(docs):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = collections.Counter(grams)
        repeat = len({j + o for j, g in enumerate(grams) if often[g] > 1 for o in range(3)})
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), repeat, failed))
    found = rules.judged(docs).collect()
    names = ("doc_id", *rules.FEATURES, "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(expected, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_rules_learn_accuracies(spark):
    rng = random.Random(3)
    true = {"a": 0.95, "b": 0.8, "c": 0.6}
    rows = []
    for _ in range(8000):
        good = rng.random() < 0.7
        rows.append(tuple(None if rng.random() < 0.2 else int(good == (rng.random() < x)) for x in true.values()))
    model = rules.fit(spark.createDataFrame(rows, "a int, b int, c int"), list(true), rounds=200)
    assert all(abs(model["accuracy"][r][k] - x) < 0.1 for r, x in true.items() for k in (0, 1)) and abs(model["prior"] - 0.7) < 0.1
    one = spark.createDataFrame([(1, None, 0)], "a int, b int, c int")
    expected = rules.posterior_of({"a": 1, "b": None, "c": 0}, model["accuracy"], model["prior"])
    assert abs(one.select(rules.posterior(model).alias("p")).first()["p"] - expected) < 1e-12


# queries and pipeline


def test_bpe_query_equals_the_library_on_the_whole_table(spark, sf_dir, reference):
    from siltline.llm.queries import op4_bpe

    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = []
    for i, t in pairs(table(spark, sf_dir, "documents")):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(reference.decode(ids, skip_special_tokens=False).encode())))
    found = op4_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_pii_query_equals_the_patterns_on_the_whole_table(spark, sf_dir):
    from siltline.llm.queries import op2_pii

    expected = []
    for i, t in pairs(table(spark, sf_dir, "documents")):
        spans = base_spans(t)
        kinds = collections.Counter(x.partition(":")[0] for x in spans.split(",") if x)
        expected.append((i, *(kinds[k] for k, _, _ in BASE), hashlib.sha256(spans.encode()).hexdigest()))
    rows = op2_pii(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == sorted(expected)
    texts = dict(pairs(table(spark, sf_dir, "documents")))
    for r in rows:
        assert set(base_spans(texts[r["doc_id"]]).split(",")) <= set(r["spans"].split(","))


def test_rules_query_equals_expectation_maximisation_in_a_loop(spark, sf_dir):
    """Votes from the features, then EM over documents one by one, with plain probabilities."""
    rows = rules.judged(table(spark, sf_dir, "documents")).collect()
    names = list(rules.default_rules())
    acc, prior = {r: [0.95, 0.3] for r in names}, 0.8

    def share(row):
        good, bad = prior, 1 - prior
        for r in names:
            if row[r] is not None:
                good *= acc[r][0] if row[r] == 1 else 1 - acc[r][0]
                bad *= acc[r][1] if row[r] == 0 else 1 - acc[r][1]
        return good / (good + bad)

    for _ in range(60):
        post = [share(row) for row in rows]
        new = {}
        for r in names:
            voted = [(p, row[r]) for p, row in zip(post, rows, strict=True) if row[r] is not None]
            on = [(1 + sum(w for w, v in voted if v == 1)) / (2 + sum(w for w, _ in voted)), (1 + sum(1 - w for w, v in voted if v == 0)) / (2 + sum(1 - w for w, _ in voted))]
            on = [min(0.999, max(0.001, x)) for x in on]
            new[r] = [on[0], max(on[1], 1.02 - on[0])]
        acc, prior = new, min(0.95, max(0.05, sum(post) / len(post)))
    for row in rows:
        expected = share(row)
        assert abs(row["posterior"] - expected) < 1e-6
        assert row["kept"] == (not row["base_failed"] and expected >= 0.5) or abs(expected - 0.5) < 1e-6


def test_very_long_texts(spark):
    """Texts of 3 MB through every operator on documents."""
    import public_tokenizers

    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choices(vocab, k=500_000))
    copy = long.replace(" w7 ", " w8 ", 40)
    item = " ".join(long.split()[250_000:250_030])
    docs = spark.createDataFrame([(1, long), (2, copy), (3, "x" * 3_000_000), (4, "short text")], "doc_id long, text string").repartition(2)
    from siltline.session import cut

    docs = cut(docs)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4]
    leaks = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["id"], r["matches"][0]["similarity"]) for r in leaks} >= {(1, 1.0)} and {r["id"] for r in leaks} <= {1, 2}
    n = {r["id"]: r["n_tokens"] for r in lm.BackoffScorer().score(docs, F.lit(True)).collect()}
    assert n == {1: 500_001, 2: 500_001, 3: 2, 4: 3}
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    assert all(abs(r["score"] - 1 / (1 + math.e)) < 1e-9 for r in toxicity.scored(docs, model).collect())
    removed = {r["id"]: (r["n_words"], r["n_removed"]) for r in substring.SubstringDedup().run_on(docs).collect()}
    assert removed[1][0] == 500_000 and removed[1][1] > 450_000 and removed[4] == (2, 0)
    assert {r["doc_id"]: r["n_words"] for r in rules.judged(docs.where("doc_id > 2")).collect()} == {3: 1, 4: 2}
    assert bpe.digests(docs.where("doc_id >= 3"), public_tokenizers.path("byte_bpe_50k.json")).count() == 2
    assert pii.spans_of(docs).where("spans != ''").count() == 0


def test_names_that_clash_with_inner_ones(spark):
    texts = ["one two three four five six", "stupid words here", "one two three four five six"]
    docs = spark.createDataFrame([(i, t, 0.25, 7, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, toxicity__ double, row__ int, print__ binary, fp__ int")
    model = toxicity.train(pa.array(["fine day", "bad insult"] * 20), np.array([0, 1] * 20))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("toxicity__ != 0.25").count() == 0
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1] and left.where("row__ != 7 OR fp__ != 1").count() == 0



def leaks_into(text, items, similarity=0.8):
    """Whether a window of the text, of an item's size, is as similar to it by weighted five-word shingles."""
    plain = lambda t: decontam.plain_words(pa.array([t], pa.string()))[1].to_pylist()
    bag = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    w = plain(text)
    for _, t in items:
        item = plain(t)
        if not item or len(set(w) & set(item)) * 2 < len(set(item)):
            continue
        n, size = min(5, len(item)), min(len(item), len(w))
        target = bag(item, n)
        for s in range(len(w) - size + 1):
            window = bag(w[s : s + size], n)
            both = (window & target).total()
            if both and both / (window.total() + target.total() - both) >= similarity:
                return True
    return False


def test_pipeline_keeps_the_columns_and_its_stages_agree_with_their_operators(spark, sf_dir, reference):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    ids, whole = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = whole
        whole = stage(spark, whole, sf_dir).cache()
        ids.append({r["doc_id"] for r in whole.select("doc_id").collect()})
        assert whole.columns[: len(docs.columns)] == docs.columns
        if name != "encoding":
            assert whole.columns == docs.columns
        if name == "near_duplicates":
            assert ids[-1] == set(brute_kept(pairs(before)))
        rows = {r["doc_id"]: r for r in whole.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, sf_dir, "labels"), ~lm.held_out("doc_id", 5, 0))
            scores = {i: float(model.score(pa.array([t]))[0]) for i, t in pairs(before)}
            assert set(rows) == {i for i, p in scores.items() if p < 0.5}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(rows) == {i for i, t in pairs(before) if not leaks_into(t, items)}
        if name == "personal_data":
            assert not any(pii.find(r["text"]) for r in rows.values() if "<" not in r["text"])
            assert {i: r["text"] for i, r in rows.items()} == {i: pii.masked(t) for i, t in pairs(before)}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "encoding":
            for i, t in pairs(before):
                tokens = reference.encode(t, add_special_tokens=False).ids
                assert rows[i]["token_ids"] == tokens and rows[i]["n_tokens"] == len(tokens) and rows[i]["text"] == t
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(ids[4])


def test_queries_with_sql(spark, sf_dir):
    import duckdb

    from siltline.llm.queries import queries
    from siltline.llm.sql import ORACLE

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in ORACLE.items():
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        expected = sorted(result.fetchall(), key=str)
        assert sorted((tuple(r[c] for c in columns) for r in queries()[name](spark, sf_dir).collect()), key=str) == expected


def test_every_operator_is_registered(spark, sf_dir):
    from siltline.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert queries()["op6_toxicity"](spark, sf_dir).columns == ["doc_id", "held_out", "score", "predicted"]
