"""Training-data operators against brute force, on small tables with nulls, ties, repeats and long rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import chat_format, embedding_dedup, fingerprints, language_id, ngram_join, packing, pieces, quality, token_counts, toxicity
from vigilspark.llm import queries as Q
from vigilspark.llm.common import Forest, components
from vigilspark.llm.wfst import Fst, compose, least_cost

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, grams string, score string"


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), None, None, 7, "g", "s") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioustn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6, 40, 200])))) for k in range(60)]
    for k in range(60, 110):  # near copies of one text, and exact ones
        w = texts[3 + k % 3][1].split() + ["tail"] * (k % 4)
        if k % 2:
            w[rng.randrange(len(w))] = "edit"
        texts.append((k, "  ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    return [*texts, (200, None), (201, ""), (202, " \t\n"), (203, "x " * 30_000), (204, "ÉÉ é   b c d e")]


def shingles(text):
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(up, up.lower())))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join_is_exact(spark, corpus):
    got = {r["doc_id"]: r for r in ngram_join.join(docs(spark, corpus)).collect()}
    sets, forest = {i: shingles(t) for i, t in corpus}, Forest()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    assert {i: (len(s), forest.root(i)) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_ngram_blocks_in_parts(spark, monkeypatch):
    """A group of near copies and two groups that share most n-grams without linking, in parts of 4 rows and 8 columns."""
    monkeypatch.setattr(ngram_join, "PART", 4)
    monkeypatch.setattr(ngram_join, "COLUMNS", 8)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    rng = random.Random(2)
    base, texts = [f"w{k}" for k in range(44)], []
    for k in range(60):
        w = base[: 30 + 7 * (k % 3)] + [f"t{k % 3}_{j}" for j in range(8)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
        texts.append((k, " ".join(w)))
    test_ngram_join_is_exact(spark, texts)


def test_ngram_links_come_from_accumulated_counts(spark, corpus, monkeypatch):
    """The product's counts are the overlaps of the pairs that link and 0 elsewhere; without the product no class links."""
    sets = [s for s in (ngram_join.ngrams(t) for _, t in corpus) if len(s)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    sizes = np.array([len(s) for s in sets])
    want[100 * want < 80 * (sizes[:, None] + sizes[None, :] - want)] = 0
    for columns in (3, 1024):
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        assert (ngram_join.overlaps(sets, sets, np.ones(want.shape, dtype=bool)) == want).all()
    assert not ngram_join.overlaps(sets, sets, np.zeros(want.shape, dtype=bool)).any()
    monkeypatch.setattr(ngram_join, "_links", lambda rows, sets: spark.createDataFrame([], "a long, b long"))
    of = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs(spark, corpus)).collect()}
    first = {}
    for i, t in corpus:
        first.setdefault(shingles(t), i)
    assert of == {i: first[shingles(t)] if shingles(t) else i for i, t in corpus}


def test_ngram_join_empty_and_null_ids(spark):
    assert ngram_join.join(docs(spark, [])).collect() == []
    got = ngram_join.join(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (1, 1), (1, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got[k] == 0 for k in range(51)) and all(got[k] == 500 for k in range(500, 560))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    texts = [*corpus, (300, "a<|endoftext|>b"), (301, "naïve \U0001f600  'll 12x\n\n\n y")]
    got = packing.pack(docs(spark, texts), Q.tokenizer_path("byte_bpe_50k.json")).collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in texts:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        total += len(ids)
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(docs(spark, []), Q.tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_constraint(rule):
    rng = random.Random(1)
    histogram = {k: rng.randint(1, 9) for k in rng.sample(range(1, 100), 40)}
    steps, n = packing.plan(histogram, 100, 3, 6000 + 4000, rule)
    bins = collections.defaultdict(list)
    for s in steps:
        for k in range(s.items):
            bins[s.bin + k // s.each].append((s.offset + k % s.each * s.length, s.length))
    assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) == n
    for items in bins.values():
        items.sort()
        assert len(items) <= 3 and sum(n for _, n in items) <= 100 and sum(n * n for _, n in items) <= 10_000
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]


def best_fit(lengths, whole, weights=(1.0, 0.05, 0.05)):
    """Item by item in decreasing length: the bin of least weighted residual norm that it fits, else a new one."""
    left, held = [], []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        rest = {b: [x - y for x, y in zip(r, need)] for b, r in enumerate(left) if all(x >= y for x, y in zip(r, need))}
        if rest:
            b = min(rest, key=lambda b: (sum(w * (x / c) ** 2 for w, x, c in zip(weights, rest[b], whole)), left[b]))
        else:
            left.append(list(whole))
            held.append([])
            b = len(left) - 1
        left[b] = [x - y for x, y in zip(left[b], need)]
        held[b].append(n)
    return held


@pytest.mark.parametrize("whole", [(100, 100, 10_000), (100, 3, 10_000), (100, 8, 2500), (60, 4, 3600)])
def test_plan_against_item_by_item(whole):
    for seed in range(15):
        rng = random.Random(seed)
        histogram = {k: rng.randint(1, 9) for k in rng.sample(range(1, 51), 25)}
        steps, n = packing.plan(histogram, *whole)
        bins = collections.defaultdict(list)
        for s in steps:
            for k in range(s.items):
                bins[s.bin + k // s.each].append(s.length)
        want = best_fit([k for k, m in histogram.items() for _ in range(m)], whole)
        assert abs(n - len(want)) <= 1 + 0.02 * len(want)
        if whole[1] >= 100:  # where tokens alone bind, the very same bins
            assert sorted(map(sorted, bins.values())) == sorted(map(sorted, want))


def test_packing_under_binding_capacities(spark, corpus):
    got = packing.pack(docs(spark, corpus), Q.tokenizer_path("byte_bpe_50k.json"), documents=8, attention=400_000, piece=512).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert len(places) <= 8 and sum(n * n for _, n in places) <= 400_000 and sum(n for _, n in places) <= 1024
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    assert any(len(x) == 8 for x in bins.values()) and sum(n for x in bins.values() for _, n in x) == sum(r["length"] for r in got)


LONG = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 5000 + "b \u3000" + "\t" * 3000, "\x1c" * 2000 + " " * 1500 + "<|endoftext|>" + " " * 1200, "x" * 200_000, "word " * 100_000 + " " * 2000]


def test_encoder_takes_long_runs(spark):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in LONG:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids, t[:20]
    d = docs(spark, list(enumerate(LONG)))
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_documents(d, path).collect()}
    tok.encode_special_tokens = True
    assert counted == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(LONG)}
    packed = collections.Counter()
    for r in packing.pack(d, path).collect():
        packed[r["doc_id"]] += r["length"]
    assert all(packed[k] == len(encode(t)) + 1 for k, t in enumerate(LONG))


def test_token_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(3)
    ids = [9 if rng.random() < 0.1 else rng.randint(10, 99) for _ in range(5000)] + [1, 2]
    (tmp_path / "f.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    want, begin = [], 0
    for k, x in enumerate(ids):
        if x == 9:
            want.append((len(want), begin, k - begin, True))
            begin = k + 1
    want.append((len(want), begin, len(ids) - begin, False))
    for size in (7, 64, 10_000):
        got = token_counts.scan(token_counts.file_blocks(spark, str(tmp_path), 2, size), end=9).collect()
        assert sorted((r["doc_index"], r["token_start"], r["n_tokens"], r["closed"]) for r in got) == want


def test_token_counts(spark, corpus):
    encode = packing.encoder(Q.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_documents(docs(spark, corpus), Q.tokenizer_path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(encode(t or "")) for i, t in corpus}


def test_token_counts_of_the_end_token_as_text(spark):
    got = token_counts.count_documents(docs(spark, [(1, "a<|endoftext|>b"), (2, "ab"), (3, "<|endoftext|>")]), Q.tokenizer_path("byte_bpe_50k.json")).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in got}
    assert len(got) == 3 and n[1] > n[3] > 1


def test_pieces_equal_the_library(spark, corpus):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    model, want = pieces.compiled(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = [t or "" for _, t in corpus] + ["".join(rng.choice(" ▁\n\taethißé漢😀\x00.,") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        ids = model.encode(t)
        assert ids == want.encode(t) and model.decode(ids) == want.decode(ids)
    got = {r["doc_id"]: r for r in pieces.encode_decode(docs(spark, corpus), path).collect()}
    assert all(got[i]["n_ids"] == len(want.encode(t or "")) and got[i]["lossless"] for i, t in corpus)


def field(number, value):
    """A field of a message in the wire format."""
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [0, 1])
def test_unigram_models_equal_the_library(rule, fallback, collapse):
    """Hand-made unigram models with the library's own character maps."""
    import sentencepiece

    rng = random.Random(8)
    charsmap = dict(pieces._wire(dict(pieces._wire(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3])).get(2, b"")
    letters = "aeinorst▁"
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))).rstrip("▁") or "a" for _ in range(250)} | set(letters)
    model = b"".join(field(1, field(1, n.encode()) + field(2, 0.0) + field(3, kind)) for n, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)))
    if fallback:
        model += b"".join(field(1, field(1, f"<0x{b:02X}>".encode()) + field(2, 0.0) + field(3, 6)) for b in range(256))
    model += b"".join(field(1, field(1, n.encode()) + field(2, -rng.uniform(1, 12) * (1 + len(n)) / 3)) for n in sorted(names))
    model += field(2, field(3, 1) + field(35, fallback)) + field(3, field(1, rule.encode()) + field(2, charsmap) + field(3, 1) + field(4, collapse) + field(5, 1))
    ours, want = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["", " ", "   ", " a  b ", "\u2460\u00bd\ufb01 ＡＢ\u3000c", "e\u0301\u0301 \u00a0x\n\ty"]
    texts += ["".join(rng.choice(letters + "  ÉéＡ①ﬁ漢\n\u0301\u200b") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        assert ours.encode(t) == want.encode(t), repr(t)
        assert ours.decode(ours.encode(t)) == want.decode(want.encode(t)) or not fallback


def test_pieces_of_runs_and_very_long_texts():
    import time

    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    model, want = pieces.compiled(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for n in [*range(1, 70), 1000]:
        for t in (" " * n, " " * n + "word", "a" + " " * n + "b", "▁" * n + "x", "=" * n, "ab" * n, "\n" * n):
            assert model.encode(t) == want.encode(t), (n, t[:20])
    for t in (" " * 1_000_000, "x" * 300_000, "\n" * 1_000_000, "no spaces" * 40_000):
        began = time.time()
        assert model.encode(t) == want.encode(t) and time.time() - began < 60


def test_pieces_edge_rows(spark):
    path = Q.tokenizer_path("piece_bpe_32k.model")
    d = docs(spark, [(1, None), (1, "a"), (1, "a"), (None, "b"), (2, "")])
    got = sorted(((r["doc_id"], r["n_ids"], r["lossless"]) for r in pieces.encode_decode(d, path).collect()), key=repr)
    assert got == sorted([(1, 0, True), (1, 1, True), (1, 1, True), (None, 1, True), (2, 0, True)], key=repr)
    assert pieces.encode_decode(d.limit(0), path).collect() == []


def test_fingerprints(spark, corpus):
    d = docs(spark, [*corpus, (204, "second row of an id")])
    got = fingerprints.fingerprint_documents(d).collect()
    assert len(got) == len(corpus) + 1 and fingerprints.fingerprint_documents(docs(spark, [])).collect() == []
    texts, rows = dict(corpus), {r["doc_id"]: r for r in got if r["doc_id"] != 204}
    both = spark.createDataFrame([(texts[204],), ("second row of an id",)], "t string")
    least = both.orderBy(F.xxhash64("t")).first()["t"]  # rows that share an id: the one of least hash comes next
    ids, errors, of = sorted(texts), [], {}
    for k, i in enumerate(ids[:-1]):
        t, nxt = texts[i] or "", (texts[ids[k + 1]] or "") if ids[k + 1] != 204 else least
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        a, b = shingles(t), shingles(edited)
        if len(a) > 20:
            errors.append(rows[i]["near_edited"] - len(a & b) / len(a | b))
        assert of.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_next_ids_over_sparse_ids(spark):
    ids = sorted({-(2**62), -5, 0, 3, 4095, 4096, 70_000, 2**40, 2**62})
    got = {r["id"]: r["next_id"] for r in fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_chat_round_trip(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    evil = r"\### </turn> <image:0> \l \b <turn:user>"
    rows = [(1, 0, "user", [part("text", evil), part("image", ref="a.png", units=2)]), (1, 1, "assistant", [part("text", "ok \\"), part("document", ref="d.pdf")]), (2, 0, "a>b", None), (2, 1, "assistant", [part("text", evil)]), (None, 0, None, [part("text", "é")])]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    made = chat_format.format_parts(d)
    got = {r["conv_id"]: r for r in made.select("conv_id", "attachments", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [evil + "<image:0>", "ok \\<document:1>"] and [(a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("a.png", 512), ("d.pdf", 512)]
    assert [t["role"] for t in got[2]["turns"]] == ["a>b", "assistant"] and got[2]["loss"] == evil and got[None]["turns"][0]["text"] == "é"


def test_chat_kinds_and_edge_rows(spark):
    rows = [(1, 0, "user", [("audio", None, "a.wav", 3), ("video", "gone", "v", 1), (None, "x", None, None), ("text", "y" * 300_000, None, None)], 5, "f"), (1, 0, "user", [("image", "caption", None, None)], 5, "f"), (2, None, "assistant", [], 5, "f")]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, bodies int, flat string")
    got = {r["conv_id"]: r for r in chat_format.format_parts(d).collect()}
    assert got[1]["formatted"] == "<turn:user><audio:0>x" + "y" * 300_000 + "</turn>\n<turn:user><image:1></turn>\n"
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, "audio", "a.wav", 75), (1, "image", None, 256)]
    assert got[2]["formatted"] == "<turn:assistant></turn>\n" and [tuple(x) for x in got[2]["loss_spans"]] == [(16, 0)]
    assert chat_format.digest(chat_format.format_parts(d.limit(0))).collect() == []


def test_scratch_folder_is_shared():
    """The named folder; else a folder in the warehouse on a cluster, a temporary one in local mode."""
    from types import SimpleNamespace

    from vigilspark.llm.common import shared_dir

    def session(app, master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(applicationId=app, master=master))

    assert shared_dir(session("a", "spark://h:7077", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert shared_dir(session("b", "spark://h:7077", spark_sql_warehouse_dir="hdfs://w/")) == "hdfs://w/vigilspark-scratch"
    own = session("c", "local[4]", spark_sql_warehouse_dir="hdfs://w/")
    assert shared_dir(own).startswith("file:///") and shared_dir(own) == shared_dir(own)
    for place in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session("d", "spark://h:7077", spark_sql_warehouse_dir=place))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    m = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5], np.zeros((1, 16))])
    rows = [(k, v.tolist(), k % 40 % 3) for k, v in enumerate(m)] + [(900, None, 1), (901, [float("nan")] * 16, 1), (902, m[0].tolist(), None), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    n, forest = collections.Counter(), Forest()
    for a in range(65):
        for b in range(65):
            if a != b and a % 40 % 3 == b % 40 % 3 and m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]) >= 0.93:
                n[a] += 1
                forest.join(a, b)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (n[i], forest.root(i)) for i in got}


@pytest.mark.parametrize("share", [0.02, 0.3, 0.6, 1.0])
def test_embeddings_of_a_large_dense_group(spark, share):
    """6,000 vectors of a label, a share of them near copies, none identical: links inside the group and outside."""
    rng = np.random.default_rng(1)
    m = rng.normal(size=(6000, 64))
    g = int(len(m) * share)
    m[:g] = m[0] + rng.normal(size=(g, 64)) * 0.2 * np.linalg.norm(m[0]) / 8
    h = (len(m) - g) // 2
    m[g : g + h] = m[g + h : g + 2 * h] + rng.normal(size=(h, 64)) * 0.33
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    assert want[:g].mean() > 0.5 * g and (g == len(m) or want[g:].any())
    rows = [(k, v.tolist(), 1) for k, v in enumerate(m)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(8)).collect()}
    found = np.array([got[k] for k in range(len(m))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    for part in (slice(0, g), slice(g, None)):
        assert found[part].sum() >= 0.99 * want[part].sum()


def test_embeddings_copies_nulls_and_repeats(spark):
    """A third are copies of one vector; null and repeated ids; a length of its own; clashing columns; no rows."""
    far = [float(k == 3) for k in range(8)]
    rows = [(k, [1.0, 2.0] + [0.0] * 6, 1) for k in range(50)] + [(50, [1.0, 2.1] + [0.0] * 6, 1), (60, far, 1), (60, far, 1), (61, far, 2), (None, far, 1), (70, [1.0], 1), (71, [2.0], 1), (72, [-1.0], 1), (5, far, 2)]
    d = spark.createDataFrame([(*r, 9, "c") for r in rows], "vec_id long, embedding array<float>, label int, n long, cid string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(d).collect()), key=repr)
    want = [(k, 50, 0, k == 0) for k in range(51)] + [(60, 1, 60, True)] * 2 + [(61, 1, 5, False), (5, 1, 5, True), (None, 0, None, False), (70, 1, 70, True), (71, 1, 70, False), (72, 0, 72, True)]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(d.limit(0)).collect() == []


def test_transducers():
    shout = Fst()
    shout.state()
    shout.arc(0, "a", "A", 1.0, 0)
    shout.arc(0, "b", "b", 0.0, 0)
    price = Fst()
    price.state()
    price.arc(0, "A", "x", 2.0, 0)
    price.arc(0, "b", "y", 0.5, 0)
    assert least_cost(compose(shout, price), "aab") == 6.5 and least_cost(compose(shout, price), "c") == float("inf")


def test_toxicity_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({"scum": 8}, {"vequ": 8}))
    toxic = lambda t: s.score(t) >= 0.7
    assert toxic("they are scum.") and toxic("un vequoir") and toxic("I will kill you") and toxic("He is scum")
    assert not toxic("he is not scum") and not toxic("she said he is scum") and not toxic('she wrote "you are scum')
    assert not toxic("you are never scum") and not toxic("I will not kill you") and not toxic('they said "I will kill you" again')
    assert toxic("he is not scum. he is scum!") and toxic("not for long will he pass for scum") and toxic('the "scum" word')
    assert s.score("to kill time") < 0.1 and s.score(None) == 0.0 and s.score("") == 0.0
    assert s.score("ok " * 200_000 + "you are scum") == s.score("ok. you are scum")


def test_toxicity_grammar_against_brute_force():
    """The composed machine's best path against rules applied one after the other, with every choice tried."""
    rng = random.Random(9)
    machine = toxicity.grammar()
    for _ in range(400):
        clause = [rng.choice(toxicity.CLASSES + ["o", "target", "neg", "report", "quote"]) for _ in range(rng.randint(1, 8))]
        now = list(clause)

        def weak(x):
            return f"i{max(1, int(x[1:]) // 4)}" if x in toxicity.INSULTS else "o" if x == "threat" else x

        told = inside = False  # quotations after a report
        for k, x in enumerate(now):
            if inside:
                now[k] = "o" if x in toxicity.INSULTS or x == "threat" else x
            if x == "quote" and told:
                inside = not inside
            told |= x == "report"
        negated, after = 0, list(now)  # the composition starts with negation
        now, told, inside = list(clause), False, False
        for k, x in enumerate(clause):
            now[k] = weak(x) if negated else x
            negated = 3 if x == "neg" else max(0, negated - 1)
        for k, x in enumerate(list(now)):
            if inside and (x in toxicity.INSULTS or x == "threat"):
                now[k] = "o"
            if x == "quote" and told:
                inside = not inside
            told |= x == "report"
        reported = False
        for k, x in enumerate(list(now)):
            now[k] = weak(x) if reported else x
            reported |= x == "report"
        near = 0
        for k, x in enumerate(list(now)):
            if near and x in toxicity.INSULTS and int(x[1:]) > 2:
                now[k] = f"i{min(8, int(x[1:]) + 1)}"
            near = 3 if x == "target" else max(0, near - 1)

        def threats(k):  # a bet on a threat pays at the first target within three words; bets do not overlap
            if k >= len(now):
                return 0.0
            best = threats(k + 1)
            if now[k] == "threat":
                for t in range(k + 1, min(k + 4, len(now))):
                    if now[t] == "target":
                        best = max(best, 6.0 + threats(t + 1))
                        break
            return best

        insults = [int(x[1:]) for x in now if x in toxicity.INSULTS]
        # One insult pays in full, those after it a quarter each.
        paid = max([0.0] + [x + 0.25 * (len(insults) - k - 1) for k, x in enumerate(insults)])
        assert -least_cost(machine, clause) == pytest.approx(paid + threats(0)), clause


@pytest.mark.parametrize(("f", "label", "modulus", "held"), [(Q.op4_toxicity, "toxic", 3, 1), (Q.op8_quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, f, label, modulus, held):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in f(spark, d).collect()}
    y = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r["score"] <= 1 for i, r in got.items())
    hits = [got[i]["predicted"] == v for i, v in y.items() if got[i]["held_out"]]
    assert np.mean(hits) > 0.95


def test_classifiers_without_labels(spark):
    d, none = docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.classify(d, none).collect()] == [0.5, 0.5]
    assert toxicity.classify(docs(spark, []), none).collect() == [] and len(toxicity.classify(d, none).collect()) == 2


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op10_language_id(spark, d).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]) > 0.95


def test_language_against_brute_force(spark):
    """Out-of-place distances from plain counters of n-grams."""
    rng = random.Random(7)
    langs = {"xa": "abcdef", "xb": "cdefgh", "xc": "efghab"}
    rows = [(k, rng.choice(list(langs))) for k in range(60)]
    texts = [(k, " ".join("".join(rng.choice(langs[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30)))) for k, lang in rows]
    learned = [(t, lang) for (k, t), (_, lang) in zip(texts, rows) if zlib.crc32(str(k).encode()) % 5]
    letters = collections.Counter("".join(t for t, _ in learned).replace(" ", ""))
    number = {c: k + 1 for k, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c)))}

    def grams(t):
        s = [0, *(number.get(c, 0) for c in t), 0]
        return [(1, (x,)) for x in s if x] + [(n, tuple(s[k : k + n])) for n in (2, 3) for k in range(len(s) - n + 1)]

    def top(counts):
        return sorted(counts, key=lambda g: (-counts[g], g))[: language_id.TOP]

    profiles = {lang: top(collections.Counter(g for t, x in learned if x == lang for g in grams(t))) for lang in langs}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs(spark, texts, dict(rows))).collect()}
    for k, t in texts:
        mine = top(collections.Counter(grams(t)))
        far = {lang: sum(abs(profile.index(g) - n) if g in profile else language_id.TOP for n, g in enumerate(mine)) for lang, profile in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert got[k] == (best, pytest.approx(1 - far[best] / language_id.TOP / len(mine)))


def test_quality_against_plain_sums(spark):
    """Scores of the whole query from its model's weights, summed indicator by indicator; hinge loss near its least value."""
    rng = random.Random(3)
    good, bad = ["A clean sentence, well made.", "Another one; it reads well."], ["BUY NOW!!! 100%", "click click click | here"]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.randint(1, 4)))) for k in range(80)]
    d = docs(spark, [*rows, (900, None), (901, ""), (902, "word " * 60_000), (902, "word " * 60_000), (None, "x")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    assert len(got) == 84 and all((got[k]["predicted"] == k % 2) for k in range(80))
    train = sorted(k for k in range(80) if zlib.crc32(str(k).encode()) % 5)
    of = quality.Indicators().of
    texts = dict(rows)
    model = quality.fit([of(texts[k]) for k in train], np.array([k % 2 for k in train]))
    for k, t in rows:
        total = norm = 0.0
        for i in of(t).tolist():
            total += float(model.weights[0][i])
            norm += float(model.weights[1][i])
        x = model.slope * (total + model.bias) / (norm + 1) ** 0.5 + model.shift
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-x)), rel=1e-4)
    assert got[900]["score"] == got[901]["score"]


def test_empty_repeated_and_long_rows(spark):
    """What every operator on documents gives for no rows, repeated rows, null ids and very long texts."""
    path, long = Q.tokenizer_path("byte_bpe_50k.json"), "the cat sat " * 100_000
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = {
        "toxicity": lambda d: toxicity.classify(d, labels), "quality": lambda d: quality.classify(d, labels), "language": language_id.identify,
        "tokens": lambda d: token_counts.count_documents(d, path), "pieces": lambda d: pieces.encode_decode(d, Q.tokenizer_path("piece_bpe_32k.model")),
        "prints": fingerprints.fingerprint_documents, "packing": lambda d: packing.pack(d, path).filter("piece = 0"), "join": ngram_join.join,
    }
    d = docs(spark, [(1, long), (1, long), (None, "a b"), (None, "a b"), (2, None)])
    for name, run in runs.items():
        assert run(d.limit(0)).collect() == [], name
        got = run(d).collect()
        assert collections.Counter(r["doc_id"] for r in got) == {1: 2, None: 2, 2: 1}, name
        drawn = [tuple(v for k, v in r.asDict().items() if k not in ("sequence_id", "offset", "file_id", "doc_index", "token_start")) for r in got]
        assert len(set(drawn)) == 3, name


def test_language_edge_cases(spark):
    d = docs(spark, [(k, "the cat and the dog") for k in range(9)] + [(20, None), (21, "12 3!"), (22, "")], {3: None})
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d).collect()}
    assert got[20] == got[21] == got[22] == "und" and got[0] == "en"
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, [(1, "abc")], {1: None})).collect()} == {"und"}


def test_languages_of_several_scripts(spark):
    """More letters than one small alphabet holds: languages that differ only in rarer scripts are told apart."""
    rng = random.Random(6)
    scripts = {"la": [chr(97 + k) for k in range(26)], "ru": [chr(0x430 + k) for k in range(40)], "xa": [chr(0x4E00 + k) for k in range(40)], "xb": [chr(0x5E00 + k) for k in range(40)]}
    rows = list(enumerate([*["la", "ru"] * 60, *["xa", "xb"] * 20]))
    texts = [(k, " ".join("".join(rng.choice(scripts[lang]) for _ in range(4)) for _ in range(60))) for k, lang in rows]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, texts, dict(rows))).collect()}
    assert got == dict(rows)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    got = corpus_pipeline.run(spark, d).collect()
    kept = {r["doc_id"] for r in got}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    groups = collections.defaultdict(set)
    for i, t in texts.items():
        groups[shingles(t)].add(i)
    assert all(len(kept & g) <= 1 for s, g in groups.items() if s)
    toxic = {r["doc_id"] for r in Q.op4_toxicity(spark, d).filter("predicted = 1").collect()}
    assert not kept & toxic and kept <= set(texts)
    forest = Forest()
    clean = {i for i, t in texts.items() if i not in toxic and re.search(r"[^\W\d_]", t or "")}
    by_gram = collections.defaultdict(set)
    for i in clean:
        for g in shingles(texts[i]):
            by_gram[g].add(i)
    for i in clean:
        mine = shingles(texts[i])
        for j, n in collections.Counter(j for g in mine for j in by_gram[g] if j < i).items():
            if 100 * n >= 80 * (len(mine) + len(shingles(texts[j])) - n):
                forest.join(i, j)
    assert kept == {forest.root(i) for i in clean}


def test_pipeline_edge_tables(spark, tmp_path):
    """No rows; null, empty and repeated rows, a very long text and extra columns with clashing names."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None), (2, ""), (3, "the cat sat on the mat"), (3, "the cat sat on the mat"), (None, "a dog ran over the hill"), (4, "one two three four " * 50_000)]
    d = docs(spark, [(k, f"the cat and the dog {k} ran off") for k in range(10, 30)] + rows)
    for kind, table in (("empty", d.limit(0)), ("rows", d)):
        at = tmp_path / kind
        at.mkdir()
        (at / "labels.parquet").symlink_to(tmp_path / "labels.parquet")
        table.write.parquet(str(at / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(at)).collect()
        if kind == "empty":
            assert got == []
    kept = collections.Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert kept[3] == kept[None] == kept[4] == 1 and not kept[1] and not kept[2] and all(kept[k] == 1 for k in range(10, 30))


def test_pipeline_keeps_rows_by_text(spark):
    """Repeated and null ids: a row goes only if another row of like text stays."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{w}{k}" for k in range(30)) for w in ("ant", "bee", "cow"))
    d = docs(spark, [(3, a), (5, a), (5, b), (None, c), (None, c), (None, a)])
    got = corpus_pipeline.one_of_each_group(spark, d, "").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == {(3, a): 1, (5, b): 1, (None, c): 1}


def test_pipeline_without_languages(spark):
    import corpus_pipeline

    d = docs(spark, [(1, "abc def"), (2, None), (3, "12 3!"), (4, "\u6f22")], dict.fromkeys((1, 2, 3, 4)))
    assert {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, d, "").collect()} == {1, 4}
