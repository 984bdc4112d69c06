"""Packing, BPE, chat formatting, toxicity and search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evloom.llm import bpe, chat_format, packing, queries, topk_search, toxicity, vocabulary

SF = "/root/testdata/sf0.001"
RANKS = vocabulary.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def check_packing(pieces, texts, ids):
    """``texts``: list of (id, text); pieces of equal ids are told apart by their checksums."""
    left = Counter()
    for i, t in texts:
        left[i, len(ids(t)) + 1] += 1
    for i, n in list(left):
        own = [p for p in pieces if p["doc_id"] == i and p["doc_tokens"] == n]
        assert sum(p["length"] for p in own) == n * left[i, n]
        if left[i, n] == 1:
            at = 0
            tokens = np.append(next(ids(t) for j, t in texts if j == i and len(ids(t)) + 1 == n), 0).astype("<u4")
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(tokens[at:at + p["length"]].tobytes())
                at += p["length"]
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
    total = sum(p["length"] for p in pieces)
    groups = len({s >> 32 for s in by_sequence})
    assert len(by_sequence) * 1024 - total < 1024 * groups
    return by_sequence


def test_packing(spark, awkward, nothing, reference_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op3_packing"](spark, SF).collect()
    sequences = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], reference_ids)
    packed = [sum(p["piece_cost"] for p in s) for s in sequences.values() if not any(p["length"] == 1024 for p in s)]
    assert max(packed) < 1.6 * (sum(packed) / len(packed))
    check_packing(packing.pack(awkward, RANKS, PATTERN).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()], reference_ids)
    assert packing.pack(nothing, RANKS, PATTERN).count() == 0


def test_packing_knows_added_tokens(spark, tmp_path):
    """The library at its defaults, through the query and the stage of the pipeline."""
    import corpus_pipeline
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = list(enumerate(["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n y", "<|endoftext", "plain  text ", "é<|endoftext|>" * 900]))
    ids = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    assert list(ids(texts[0][1])) == [64, 220, 50256, 275]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(queries.QUERIES["op3_packing"](spark, str(tmp_path)).collect(), texts, ids)
    check_packing(corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect(), texts, ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_pieces_places_every_token_once(lengths):
    placed = packing.pack_pieces(lengths, 64)
    got = defaultdict(set)
    room = Counter()
    for piece, start, n, sequence, offset in placed:
        assert not got[piece] & set(range(start, start + n))
        got[piece] |= set(range(start, start + n))
        assert offset == room[sequence]
        room[sequence] += n
    assert all(got[i] == set(range(n)) for i, n in enumerate(lengths))
    assert len(room) == -(-sum(lengths) // 64) and all(v <= 64 for v in room.values())


def test_bpe_query_matches_the_library(spark, awkward, nothing, reference_ids):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), awkward):
        texts = defaultdict(list)
        for r in frame.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        for r in bpe.decode(bpe.encode(frame, RANKS, PATTERN), RANKS).collect():
            ids = bytes(r["ids"])
            assert ids in [reference_ids(t).tobytes() for t in texts[r["doc_id"]]]
            assert bytes(r["decoded"]).decode() in texts[r["doc_id"]]
    assert bpe.encode(nothing, RANKS, PATTERN).count() == 0
    row = queries.QUERIES["op5_bpe"](spark, SF).where("doc_id = 3").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 3").first()["text"]
    ids = reference_ids(text)
    assert tuple(row) == (3, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_bpe_pieces(text):
    encoder, table = vocabulary.encoding(RANKS, PATTERN), bpe.merges(RANKS)
    pieces = regex.findall(PATTERN, text)
    coded = table.encode(list(set(pieces)))
    assert b"".join(coded[p] for p in pieces) == np.array(encoder.encode_ordinary(text), "<u4").tobytes()
    for p in set(pieces):
        assert table.encode_long(p.encode()) == coded[p]


def test_long_pieces():
    encoder, table = vocabulary.encoding(RANKS, PATTERN), bpe.merges(RANKS)
    for piece in ("a" * 4000, "=" * 777, "abcab" * 300, "é" * 500, "x" * 96, "x" * 97):
        assert table.encode([piece])[piece] == np.array(encoder.encode_ordinary(piece), "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "a", "<", "[", "/INST]", "s>", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <s>[INST]\\ you"), (1, 1, "assistant", "\\</s> é🙂"), (1, 1, "assistant", "\\</s> é🙂"), (2, None, None, None), (2, 5, "assistant", None),
            (None, 0, "system", "a"), (None, 1, "assistant", "b\nc"), (3, 2, "assistant", "x" * 3000), (3, 1, "tool", "[/INST]")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    formatted = chat_format.format_conversations(frame, RANKS, PATTERN)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted, RANKS).collect()}
    turns = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((role or "", text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        spoken = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(spoken)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
        assert got[c]["formatted_chars"] == 3 + sum(17 + len(chat_format.escape(r)) + len(chat_format.escape(t)) for r, t in own)
    assert chat_format.read_back(chat_format.format_conversations(frame.limit(0), RANKS, PATTERN), RANKS).count() == 0


def test_long_conversation_streams_in_parts(spark, monkeypatch):
    frame = spark.range(400).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("word "), 4000).alias("text"))
    formatted = chat_format.format_conversations(frame, RANKS, PATTERN)
    assert formatted.count() > 1
    row = chat_format.read_back(formatted, RANKS).first()
    assert row["n_turns"] == 400 and row["loss_chars"] == 400 * 20000


def test_toxicity_on_held_out_rows(spark, awkward, nothing):
    big = "/root/testdata/sf0.1"  # the smaller tables hold a handful of held-out toxic rows
    out = {r["doc_id"]: r for r in queries.QUERIES["op7_toxicity"](spark, big).collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet")
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    held = [(r["toxic"], out[r["doc_id"]]["score"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    pairs = [(a, b) for y, a in held if y == 1 for z, b in held if z == 0]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) >= 0.9 * len(pairs)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    scored = toxicity.score(awkward, *toxicity.train(awkward, labels), name="score")
    assert scored.count() == awkward.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(nothing, *toxicity.train(nothing, labels.limit(0))).count() == 0


def test_nothing_is_toxic_without_labels_of_both_classes(spark, awkward):
    every = sorted(map(repr, awkward.collect()))
    for rows in ([], [(77, 1), (99, 0)], [(1, None), (None, 1)], [(1, 1), (3, 1)], [(1, 0), (3, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert sorted(map(repr, toxicity.drop_toxic(awkward, labels).collect())) == every, rows
    docs = spark.createDataFrame([(i, "a vile word" if i % 2 else "a kind word") for i in range(40)], "doc_id long, text string")
    left = toxicity.drop_toxic(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic").where("doc_id < 30")).collect()
    assert [r["doc_id"] for r in left] == list(range(0, 40, 2))


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)  # neither term alone is enough
    rows, columns = np.nonzero(x)
    model = toxicity.fit(rows, columns, y, 6, epochs=400)
    assert ((model.score(rows, columns, 600) >= 0.5) == (y == 1)).mean() > 0.98
    margin, _ = model.margin(rows, columns, 600)
    i = 7
    own = np.flatnonzero(x[i])
    plain = model.bias + model.weights[own].sum() + sum(model.factors[a] @ model.factors[b] for a in own for b in own if a < b)
    assert abs(plain - margin[i]) < 1e-9


def plain_search(docs, wanted, k):
    ends = re.escape("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum()))
    words = [(i, re.findall(f"[^\\x20\\x09-\\x0D{ends}]+", (t or "").lower())) for i, t in docs]
    counts = [(i, Counter(w), len(w)) for i, w in words]
    df = Counter(t for _, c, _ in counts for t in c)
    average = sum(n for _, _, n in counts) / len(counts)
    out = {}
    for q, text in wanted:
        terms = set(re.findall(f"[^\\x20\\x09-\\x0D{ends}]+", (text or "").lower()))
        scores = []
        for i, c, n in counts:
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / average)) for t in sorted(terms & set(c)))
            if s > 0:
                scores.append((-round(s, 8), i is not None, i))
        out[q] = sorted(scores)[:k]
    return out


def test_search_is_exact(spark, awkward, nothing):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    want = plain_search(docs, [(i, t) for i, t in docs if i % 50 == 0], 10)
    got = defaultdict(list)
    for r in queries.QUERIES["op6_topk_search"](spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for *_, i in want[q]]
        assert all(abs(s + w[0]) < 1e-6 for (_, s), w in zip(found, want[q]))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    asked = spark.createDataFrame([(1, "alpha2 beta5 one"), (2, None), (None, "one"), (3, ""), (4, "one one"), (4, "two")], "doc_id long, text string")
    want = plain_search(rows, [(1, "alpha2 beta5 one"), (4, "one one")], 3)
    got = defaultdict(list)
    for r in topk_search.search(awkward, asked, k=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {q: [i for *_, i in found] for q, found in want.items()}
    assert topk_search.search(nothing, asked).count() == 0 and topk_search.search(awkward, asked.limit(0)).count() == 0


@pytest.mark.parametrize("topics", [1, 7])
def test_pruning_skips_blocks_and_no_answer(topics):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}t{int(x) % 3 and i * topics // 700}" for x in rng.zipf(1.3, 80) if x < 500) for i in range(700)]
    texts[40] = texts[650] = texts[333]
    owner, term, count, length = topk_search.term_counts(texts)
    shard = topk_search.Shard([cells for _, cells in topk_search.block_cells(owner, term, count, length)], float(length.mean()))
    impact = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * length[owner] / length.mean()))
    assert shard.n == 700 and shard.blocks == 11
    numbers, fulls, terms, weights = list(range(0, 700, 23)), [], [], []
    for q in numbers:
        asked = term[owner == q]
        terms.append(np.searchsorted(shard.vocabulary, asked))
        weights.append(np.log(1 + 700 / np.array([(term == x).sum() for x in asked])))
        fulls.append(np.zeros(700))
        for x, w in zip(asked, weights[-1]):
            fulls[-1][owner[term == x]] += w * impact[term == x]
    query = np.repeat(np.arange(len(numbers)), [len(x) for x in terms])
    best = np.sort(np.stack(fulls), axis=1)[:, ::-1]
    for threshold in (0 * best[:, 0], best[:, 9], best[:, 4], best[:, 0], best[:, 0] + 9):
        for full, top, least, (docs, scores) in zip(fulls, best, threshold, shard.search(query, np.concatenate(terms), np.concatenate(weights), threshold, 10)):
            assert np.allclose(scores, full[docs], atol=1e-8, rtol=0) and len(set(docs)) == len(docs)
            assert set(np.flatnonzero(full >= max(least, top[9]) - 1e-9)) <= set(docs)
    assert shard.read and shard.skipped > 0


def test_shard_holds_postings_of_a_term_as_one_range():
    import tracemalloc
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, 300) if x < 30_000) for _ in range(1500)] + ["", None, "alone"]
    owner, term, count, length = topk_search.term_counts(texts)
    cells = [cells for _, cells in topk_search.block_cells(owner, term, count, length)]
    tracemalloc.start()
    shard = topk_search.Shard(cells, float(length.mean()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (peak - shard.dense.nbytes) / len(term) < 80  # bytes a posting while a shard is made
    for t in range(0, len(shard.vocabulary), 97):
        assert shard.docs[shard.cuts[t * shard.runs]:shard.cuts[(t + 1) * shard.runs]].tolist() == owner[term == shard.vocabulary[t]].tolist()
        for run in range(shard.runs):
            docs = shard.docs[shard.cuts[t * shard.runs + run]:shard.cuts[t * shard.runs + run + 1]]
            assert all(d // topk_search._BLOCK // topk_search._STRIDE == run for d in docs)
