"""The queries against plain restatements: loops over whole tables, the tokenizers library, another HTML parser."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from test_spark import docs, folder, rows  # noqa: F401

import corpus_pipeline
from presswork.llm import langid, minhash, mixing, near, quality, queries, suffix
from presswork.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest table with what it doesn't have: null and empty texts, a text without white space, marks of several bytes, special strings."""
    path = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "漢字かな交じり文。" * 300, "a" * 70_000, "é́ ΑΣ İ <|endoftext|> 'll we'RE", "x" * 500 + " " + "y1" * 900, "\x00\x1c\x85 ", "😀" * 50]
    have = [(r["doc_id"], r["text"]) for r in table("documents")]
    spark.createDataFrame(have + [(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_op6_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = by_id(queries.op6_bpe(spark, odd))
    have = spark.read.parquet(f"{odd}/documents.parquet").collect()
    assert len(got) == len(have)
    for r in have:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_op8_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = by_id(queries.op8_token_counts(spark, odd))
    for r in spark.read.parquet(f"{odd}/documents.parquet").collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[r["doc_id"]][1:]) == (len((r["text"] or "").encode()), n, n > 1024)


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def grams(text):
    w = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in text.split()]
    out = []
    for at in range(max(1, len(w) - 4) if w else 0):
        h = len(w) if len(w) < 5 else 0
        for x in w[at : at + 5]:
            h = (h * 0x9E3779B97F4A7C15 + x) & M
        out.append(mix(h))
    return out


def test_op5_by_loops(spark, odd):
    a, b = minhash._A[:, 0].tolist(), minhash._B[:, 0].tolist()

    def print_of(text):
        low = [x >> 32 for x in set(grams(text))]
        least = [min(((p * x + q) & M for x in low), default=M) >> 32 for p, q in zip(a, b, strict=True)]
        return [((v * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for v in least]

    have = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{odd}/documents.parquet").collect() if len(r["text"] or "") < 9000), reverse=True)[:120]
    spark.createDataFrame(have, "doc_id long, text string").write.mode("overwrite").parquet(f"{odd}/some/documents.parquet")
    got = by_id(queries.op5_fingerprints(spark, f"{odd}/some"))
    prints = [print_of(t) for _, t in have]
    for k, (d, text) in enumerate(have):
        after = have[(k + 1) % len(have)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        new = print_of(edited)
        g, following = got[d], prints[(k + 1) % len(have)]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g["fingerprint"] == "".join(f"{v:04x}" for v in prints[k]) and g["edited_fingerprint"] == "".join(f"{v:04x}" for v in new)
        assert g["near_edited"] == sum(x == y for x, y in zip(prints[k], new, strict=True)) / 128
        assert g["near_next"] == sum(x == y for x, y in zip(prints[k], following, strict=True)) / 128


def held(doc, folds, fold):
    return zlib.crc32(str(doc).encode()) % folds == fold


def test_op1_by_loops(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    label = {r["doc_id"]: r["quality"] for r in table("labels") if r["quality"] is not None and r["doc_id"] in texts and not held(r["doc_id"], 5, 0)}
    order = [r[0] for r in spark.createDataFrame([(d,) for d in label], "d long").orderBy(F.xxhash64("d"), "d").collect()]

    def counts(text):
        words = quality.words_of(text)
        return Counter(quality.features(words).tolist()) if words else Counter(), len(words)

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    bias = 1 << quality.BITS
    for _ in range(quality.EPOCHS):
        for d in order:
            c, size = counts(texts[d])
            x = {i: float(np.float32(k / max(1.0, math.sqrt(size)))) for i, k in c.items()} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label[d]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = by_id(queries.op1_quality(spark, SF))
    assert set(got) == set(texts)
    for d, text in texts.items():
        c, size = counts(text)
        s = weight(bias) + sum(weight(i) * k for i, k in c.items()) / math.sqrt(size) if size else weight(bias)
        p = 1 / (1 + math.exp(-s))
        assert got[d]["held_out"] == held(d, 5, 0) and abs(got[d]["score"] - p) < 2e-3 and got[d]["predicted"] == int(got[d]["score"] >= 0.3)


def test_op3_by_loops(spark):
    table_ = table("documents")
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), queries.crc_mod("doc_id", 4) != 2)
    import io

    m = np.load(io.BytesIO(model))
    w, bias, code, trust, names = m["w"].astype(float), m["bias"], m["code"], m["trust"], [str(x) for x in m["names"]]
    got = by_id(queries.op3_langid(spark, SF))
    for r in table_[:60]:
        text = (r["text"] or "")[:3000] if len(r["text"] or "") <= 3000 else None
        if text is None:
            continue
        g = got[r["doc_id"]]
        assert g["held_out"] == held(r["doc_id"], 4, 2)
        if not any(c.isalpha() for c in text):
            assert g["lang_pred"] == "und"
            continue
        data = f" {text.lower()} ".encode("utf-8", "surrogatepass")
        total, count = np.zeros(w.shape[1]), 0
        for at in range(len(data)):
            h = (data[at] * 0x85EBCA6B) & 0xFFFFFFFF
            for k in range(1, 4):
                if at + k >= len(data):
                    break
                h = (((h ^ (h >> 13)) * 0xC2B2AE35) + data[at + k] * 0x27D4EB2F) & 0xFFFFFFFF
                total += w[(((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> 16]
                count += 1
        f = total / max(1, count) * langid.SCALE + bias
        loss = [sum(t * math.log1p(math.exp(-c * v)) for c, v, t in zip(row.tolist(), f, trust, strict=True)) for row in code]
        share = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(names)), key=lambda i: share[i])
        assert g["lang_pred"] == names[best] and abs(g["score"] - share[best] / sum(share)) < 1e-4


class Words(HTMLParser):
    """The visible words of well-formed pages, without layout."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out += data.split()


def test_op2_shows_all_visible_words(spark):
    pages = {r["page_id"]: r for r in table("pages")}
    got = {r["page_id"]: r for r in queries.op2_html(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        p = Words()
        p.feed(page["html"])
        p.close()
        said = [w for w in got[i]["text"].split() if w != "-"]
        assert said == [w for w in p.out if w != "-"] and got[i]["url"] == page["url"] and got[i]["n_lines"] == got[i]["text"].count("\n") + 1


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes_of(texts, threshold=0.8):
    """Class number of each text: components of all pairs at or over the threshold, found by shared shingles."""
    up = list(range(len(texts)))

    def top(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    pairs, seen, first = 0, defaultdict(list), {}
    for k, t in enumerate(texts):
        b = bag(t)
        same = first.setdefault(frozenset(b.items()), k)
        if same != k:
            up[top(k)] = top(same)
            continue
        size = sum(b.values())
        for j in {j for g in b for j in seen[g]}:
            low = sum((b & bags[j]).values())
            if low >= threshold * (size + sum(bags[j].values()) - low):
                pairs += 1
                up[top(k)] = top(j)
        bags[k] = b
        for g in b:
            seen[g].append(k)
    return [top(k) for k in range(len(texts))], pairs


bags: dict[int, Counter] = {}


def test_op10_finds_every_pair_of_a_table(spark, tmp_path):
    """Families of texts whose likeness goes from 0.7 to 1: the classes are those of all pairs at 0.8 or over, none missed."""
    draw = random.Random(12)
    made = []
    for _ in range(220):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(30, 200))]
        for _ in range(4):
            new = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 60))):
                new[draw.randrange(len(new))] = f"v{draw.randrange(5000)}"
            made.append(" ".join(new))
    draw.shuffle(made)
    have = [{"doc_id": i, "text": t} for i, t in enumerate(made)] + [{"doc_id": 10_000 + r["doc_id"], "text": r["text"]} for r in table("documents")]
    bags.clear()
    label, pairs = classes_of([r["text"] for r in have])
    assert pairs > 400
    want = defaultdict(list)
    for r, c in zip(have, label, strict=True):
        want[c].append(r["doc_id"])
    spark.createDataFrame([(r["doc_id"], r["text"]) for r in have], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op10_near_dedup(spark, str(tmp_path)))
    for ids in want.values():
        for d in ids:
            assert (got[d]["class_id"], got[d]["class_rows"], got[d]["kept"]) == (min(ids), len(ids), d == min(ids))


def test_op10_with_heavy_bags_and_small_blocks(spark, docs, monkeypatch):  # noqa: F811
    plain = sorted(map(str, near_rows(docs)))
    monkeypatch.setattr(near, "HEAVY", 12)
    monkeypatch.setattr(near, "BLOCK_NODES", 2)
    monkeypatch.setattr(near, "CHUNK_NODES", 2)
    assert sorted(map(str, near_rows(docs))) == plain


def near_rows(df):
    from presswork.llm import bagminhash

    return [(r["doc_id"], r["class_id"], r["class_rows"]) for r in bagminhash.near_classes(df).collect()]


def test_op9_ranges_of_heavy_ids_and_many_sources(spark, tmp_path, monkeypatch):
    made = [(i % 50 if i % 3 else None, f"s{i % 4}") for i in range(900)]
    spark.createDataFrame(made, "doc_id long, source string").repartition(4).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    key = lambda df: sorted((r["source"], r["mix_rank"], str(r["doc_id"]), r["mix_slot"]) for r in mixing.pfair_order(df).collect())
    plain = key(d)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    monkeypatch.setattr(mixing, "HEAVY", 10)
    assert key(d) == plain
    monkeypatch.setattr(mixing, "SQL_SOURCES", 1)
    assert key(d) == plain
    slots = mixing.quantised({f"s{k}": 1.0 + k % 7 for k in range(120)}, 840)
    assert mixing.frame_rows(slots, 840) == [tuple(r) for r in spark.sql(mixing.frame_sql(slots, 840)).orderBy("slot").collect()]


def test_rows_are_known_by_place_only_in_scans(spark, docs):  # noqa: F811
    """What isn't a scan is written first, so a shuffled or random input gives the same answers."""
    from presswork.llm import bagminhash, exact

    other = docs.repartition(5, F.rand(3))
    assert sorted(map(str, near_rows(other))) == sorted(map(str, near_rows(docs)))
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert ids(exact.drop_copies(other)) == ids(exact.drop_copies(docs))
    assert ids(bagminhash.drop_near_copies(other)) == ids(bagminhash.drop_near_copies(docs))
    clash = docs.withColumn("_dedup_row", F.lit("own")).withColumn("_Near_Row", F.lit("own")).withColumn("_quality_text", F.lit("own"))
    for out in (exact.drop_copies(clash), bagminhash.drop_near_copies(clash), quality.keep_good(clash, quality._dump(quality.fit(iter(()))))):
        assert out.columns == clash.columns and out.where("_dedup_row <> 'own' or _Near_Row <> 'own' or _quality_text <> 'own'").isEmpty()
    n = [(r["doc_id"], r["n_removed"]) for r in suffix.repeat_digest(other).collect()]
    assert sum(k for _, k in n) == sum(r["n_removed"] for r in suffix.repeat_digest(docs).collect())


def test_training_on_repeated_ids(spark):
    same = [(1, f"the words of row {i} are fine", "en", 1) for i in range(10_000)] + [(2, "die worte sind gut", "de", 0)]
    d = spark.createDataFrame(same, "doc_id long, text string, lang string, quality int")
    model = langid.predictor(langid.train(d.select("doc_id", "text", "lang"), F.lit(True)))
    assert model("the words are")[0] == "en" and model("die worte")[0] == "de"
    w = quality.train(d.select("doc_id", "text"), d.select("doc_id", "quality"), F.lit(True))
    assert len(np.load(__import__("io").BytesIO(w))["w"]) == (1 << quality.BITS) + 1


def test_training_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 30)
    monkeypatch.setattr(langid, "TRAIN_CHARS", 30)
    long = "noise " * 100
    assert np.array_equal(quality.fit(iter([("good words", 1), (long, 0), ("bad!! one", 0)])), quality.fit(iter([("good words", 1), ("bad!! one", 0)])))
    assert langid.fit(iter([("the one", "en"), (long, "xx"), ("das eine", "de")])) == langid.fit(iter([("the one", "en"), ("das eine", "de")]))


def order_of(known, frame=mixing.FRAME, block=mixing.BLOCK_ROWS):
    """The Pfair order of rows (doc_id, source) by a heap over all blocks: list of their numbers, slots and ranks."""
    by = defaultdict(list)
    for k, (d, s) in enumerate(known):
        by["(null)" if s is None else s].append(k)
    slots = mixing.quantised({s: len(v) ** 0.5 for s, v in by.items()}, max(frame, 2 * len(by)))
    frame = max(frame, 2 * len(by))
    placed = {}
    for s, ks in by.items():
        ks.sort(key=lambda k: (hashlib.md5(("" if known[k][0] is None else str(known[k][0])).encode()).hexdigest(), known[k][0] or 0))
    names = sorted(slots)
    following = [0] * len(names)
    left = max((len(v) + block - 1) // block for v in by.values())
    t = 0
    while any(following[i] < (len(by[s]) + block - 1) // block for i, s in enumerate(names)) and t < left * frame:
        ready = []
        for i, s in enumerate(names):
            w, k = slots[s], following[i]
            base, r = k // w * frame, k % w
            if base + r * frame // w <= t and base <= t // frame * frame:
                heapq.heappush(ready, (base + ((r + 1) * frame + w - 1) // w, i))
        _, i = heapq.heappop(ready)
        for rank in range(following[i] * block, min(len(by[names[i]]), following[i] * block + block)):
            placed[by[names[i]][rank]] = (t, rank)
        following[i] += 1
        t += 1
    return placed


def test_pipeline_by_loops(spark, docs, folder):  # noqa: F811
    """All stages in plain Python over the fixture, from the classifier's scores on."""
    from tokenizers import Tokenizer

    model = queries.quality_model(spark, docs, folder)
    score = quality.scorer(model)
    known = [(r[0], r[1], r[3]) for r in rows()]
    good = score([t or "" for _, t, _ in known])
    known = [k for k, p in zip(known, good, strict=True) if p >= 0.3]
    null = lambda d: -1 if d is None else d
    best = {}
    for d, t, s in known:
        if t is None:
            t = ""
        if t not in best or null(d) > null(best[t][0]):
            best[t] = (d, t, s)
    known = list(best.values())
    bags.clear()
    label, _ = classes_of([t for _, t, _ in known])
    least = {}
    for k, (row, c) in enumerate(zip(known, label, strict=True)):
        if c not in least or null(row[0]) < null(known[least[c]][0]):
            least[c] = k
    known = [known[k] for k in sorted(least.values())]
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for k, (slot, rank) in order_of([(d, s) for d, _, s in known]).items():
        ids = lib.encode(known[k][1], add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        want.append((null(known[k][0]), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), slot, rank))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_slot", "mix_rank"]
    assert sorted((null(r[0]), *r[1:]) for r in got.collect()) == sorted(want) and want


def test_pipeline_states_the_mix_whatever_the_files(spark, tmp_path):
    """With many files, and without adaptive execution that would merge them, the last stage still says each row's place."""
    made = [(i, f"text number {i} of all of them here", "en", f"s{i % 3}", 1) for i in range(600)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = corpus_pipeline.mix(spark, d, "")
        mixed.repartition(9).write.parquet(f"{tmp_path}/m")
        out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/m"), "")
        want = [r["doc_id"] for r in mixing.pfair_order(d).orderBy("mix_slot", "mix_rank").collect()]
        assert [r["doc_id"] for r in out.orderBy("mix_slot", "mix_rank").collect()] == want == [r["doc_id"] for r in mixed.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
