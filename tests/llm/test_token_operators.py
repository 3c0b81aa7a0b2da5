"""Tokens, packing, token files, sharding, WARC and nearest neighbours against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, TEXTS
from tradewind.llm import bpe, nearest, packing, sharding, token_files, tokens, warc

ODD = [*"aB9 \n\t\r\x0b\x1c\x85é́ñß中😀İΣςǅﬁ'’s<|>.,!_-​٣½ª", "\xa0", "　", "'ll", "'S", " 't", "<|endoftext|>", "<|startoftext|>", "  ", "the", "The"]


def odd_texts(n: int) -> list[str]:
    chance = random.Random(5)
    return ["".join(chance.choice(ODD) for _ in range(chance.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(tokens.vocabulary_path(n)) for n in (tokens.BYTE_BPE, tokens.WORD_BPE)}


# --- tokens -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_pieces_give_the_ids_of_whole_texts(library, name):
    own = tokens.library(tokens.vocabulary_path(name))
    marked = [f"{a}{b}{c} {a}{b}" for a in ODD for b in (".", ",;", "!?.", ":)", "'s.", "x,") for c in ODD]
    marked += [f"{a}{b}{c}" for a in ODD for b in ("\n", ".\n", " \n", "\n ", "\n\n", "\n'") for c in ODD]
    for text in odd_texts(3_000) + marked + [t or "" for _, t in TEXTS]:
        assert own.ids(text).tolist() == library[name].encode(text, add_special_tokens=False).ids, text


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokens, "_LOADED", {})
    own = tokens.library(tokens.vocabulary_path(tokens.BYTE_BPE))
    for text in odd_texts(300):
        assert own.ids(text).tolist() == library[tokens.BYTE_BPE].encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 3


def test_new_words_of_a_text_share_one_library_text(library, monkeypatch):
    monkeypatch.setattr(tokens, "_LOADED", {})
    own = tokens.library(tokens.vocabulary_path(tokens.BYTE_BPE))
    encode, calls = own.encode, []
    monkeypatch.setattr(own, "encode", lambda new: calls.append(len(new)) or encode(new))
    for text in ("Unseen words, on\nthree lines;\nand more words.", "more words,\nthree new lines; on", "Unseen words, on"):
        assert own.ids(text).tolist() == library[tokens.BYTE_BPE].encode(text, add_special_tokens=False).ids
    assert calls == [1, 1]


def test_marks_after_known_words_need_no_library(library, monkeypatch):
    monkeypatch.setattr(tokens, "_LOADED", {})
    own = tokens.library(tokens.vocabulary_path(tokens.BYTE_BPE))
    own.ids("a known word. 3, é?!")
    own.ids("a known word 3 é word?!")
    encode, calls = own.encode, []
    monkeypatch.setattr(own, "encode", lambda new: calls.append(new) or encode(new))
    monkeypatch.setattr(tokens, "CACHE_MARKS", 2)
    for text in ("a known. word, known,", "known?! 3?! known. é.", "a known:; word:; 3... é::", "a known, word,"):
        assert own.ids(text).tolist() == library[tokens.BYTE_BPE].encode(text, add_special_tokens=False).ids
    assert not any("word" in x for new in calls for x in new) and len(own.marks) <= 2


def test_words_of_many_texts_share_library_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "_LOADED", {})
    own = tokens.library(tokens.vocabulary_path(tokens.WORD_BPE))
    encode, calls = own.encode, []
    monkeypatch.setattr(own, "encode", lambda new: calls.append(len(new)) or encode(new))
    text = "Unseen Words, unseen wörds; ÊTRE être, words and\nmore (words words!? words."
    assert own.ids(text).tolist() == library[tokens.WORD_BPE].encode(text, add_special_tokens=False).ids
    assert calls == [1, 6]  # the words as one text; (words and the five kinds of marks, no marks among them
    text = "words! more, unseen. UNSEEN! (words"
    assert own.ids(text).tolist() == library[tokens.WORD_BPE].encode(text, add_special_tokens=False).ids
    assert calls == [1, 6, 1]  # for the new mark alone


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
@pytest.mark.parametrize("full", [False, True])
def test_ids_of_many_texts_at_once(library, monkeypatch, name, full):
    monkeypatch.setattr(tokens, "_LOADED", {})
    if full:
        monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
        monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    own = tokens.library(tokens.vocabulary_path(name))
    # capitals without a composed form of their own, marks that are a part of an added token, and long words
    texts = ["J\u030c j\u030c I\u0307 ÿ\u0301 \u0301a A\u030a", "a<|endoftext|>. a<|endoftext| <|ENDOFTEXT|> |>a>.", "ab" * 300 + "., x'.s' don't' It's!"]
    texts = pa.array([None, "", *texts, *odd_texts(2_000), *[t for _, t in TEXTS], None])
    for part in (texts, texts[3:1_000], texts[:0], texts):
        at, ids = own.many(part)
        wanted = [library[name].encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted
    assert not full or len(own.known) <= 3


def test_every_plain_letter_stays_one_word(library):
    letters = [c for c in map(chr, range(256)) if tokens._WORD.fullmatch(c)]
    assert len(letters) == 52 + 62
    own = tokens.library(tokens.vocabulary_path(tokens.WORD_BPE))
    texts = [a + b + c + m for a in letters for b, c, m in (("", "", ""), ("s", "é", ""), ("Ê", "T", "?"), ("ß", a, "'"))]
    at, ids = own.many(pa.array(texts))
    for text, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == library[tokens.WORD_BPE].encode(text, add_special_tokens=False).ids, text


def test_white_space_and_cut_marks_keep_their_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "_LOADED", {})
    own = tokens.library(tokens.vocabulary_path(tokens.BYTE_BPE))
    chance = random.Random(8)
    alphabet = [*"a.\n\n   \t\x1c\x85\xa0\u2028", tokens.CUT, "'s", "<|endoftext|>"]
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 9))) for _ in range(5_000)]
    for text in [*texts, *texts, "a" + " " * 5_000 + "a", "\n" * 5_000]:  # again with known pieces
        assert own.ids(text).tolist() == library[tokens.BYTE_BPE].encode(text, add_special_tokens=False).ids, text


def test_own_bpe_is_the_library(library):
    own, pieces = bpe.loaded(tokens.vocabulary_path(tokens.WORD_BPE))
    theirs = library[tokens.WORD_BPE]
    for text in odd_texts(3_000) + [t or "" for _, t in TEXTS] + ["a" * 3_000, "ab" * 300, "!" * 500, "supercali" * 60]:
        ids = pieces.ids(text).tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_heap_and_array_merge_alike():
    own, _ = bpe.loaded(tokens.vocabulary_path(tokens.WORD_BPE))
    chance = random.Random(2)
    for _ in range(300):
        word = "".join(chance.choice("abeinorst") for _ in range(chance.randint(1, 120))).encode()
        parts = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
        assert own.merged_by_heap(parts) == own.encode_word(word)


def test_round_trip_of_messy_documents(messy, nothing, library):
    path, theirs = tokens.vocabulary_path(tokens.WORD_BPE), library[tokens.WORD_BPE]
    rows = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in bpe.round_trip(messy, path).collect()), key=repr)
    wanted = [(d, theirs.encode(t or "", add_special_tokens=False).ids) for d, t in TEXTS]
    assert rows == sorted(((d, i, theirs.decode(i, skip_special_tokens=False)) for d, i in wanted), key=repr)
    assert bpe.round_trip(nothing, path).count() == 0


# --- token files --------------------------------------------------------------------------------------------


def test_token_files_in_order(spark, messy, nothing, library, tmp_path):
    path, theirs = tokens.vocabulary_path(tokens.WORD_BPE), library[tokens.WORD_BPE]
    target = str(tmp_path / "files")
    token_files.write(messy, target, path, 4)
    start = 0
    rows = token_files.read(spark, target).orderBy("start").collect()
    ordered = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for row, (doc, text) in zip(rows, ordered, strict=True):
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert (row["doc_id"], row["start"], row["n_tokens"], list(row["ids"])) == (doc, start, len(ids), ids)
        start += len(ids)
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checksums(spark, target).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    plan = token_files.read(spark, target).select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan  # metadata alone is read
    empty = str(tmp_path / "none")
    token_files.write(nothing, empty, path, 4)
    assert token_files.checksums(spark, empty).count() == 0


def test_slices_hold_every_row_once(spark, monkeypatch, messy, library):
    texts = [None, "", "a" * 7, "b" * 25, "", "c" * 3, None, "d" * 10, "e", "f"]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(10), "text": texts})
    for size in (1, 10, 1_000):
        monkeypatch.setattr(token_files, "SLICE", size)
        parts = list(token_files.slices(batch))
        assert [x for p in parts for x in p.to_pydict()["text"]] == texts
        assert all(sum(len(x or "") for x in p.to_pydict()["text"][1:]) <= size for p in parts)
    assert len(parts) == 1 and not list(token_files.slices(batch[:0]))
    path, theirs = tokens.vocabulary_path(tokens.WORD_BPE), library[tokens.WORD_BPE]
    rows = token_files.encoded(messy.select("doc_id", "text"), path).collect()
    wanted = [(i, theirs.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]) for i, t in TEXTS]
    assert sorted([(r["doc_id"], list(r["ids"])) for r in rows], key=repr) == sorted(wanted, key=repr)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


# --- packing ------------------------------------------------------------------------------------------------


def check_places(rows, caps):
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = bins.setdefault(r["sequence_id"], [0, 0, 0])
        assert r["offset"] == own[0]
        own[0], own[1], own[2] = own[0] + r["length"], own[1] + 1, own[2] + r["length"] ** 2
    for own in bins.values():
        assert own[0] <= caps.tokens and own[1] <= caps.documents and own[2] <= caps.cost
    return len(bins)


def test_packing_fills_sequences(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    caps = packing.Capacities()
    rows = packing.packed_documents(docs, tokens.vocabulary_path(tokens.BYTE_BPE), caps).collect()
    assert check_places(rows, caps) <= -(-sum(r["length"] for r in rows) // caps.tokens) + 1
    theirs = library[tokens.BYTE_BPE]
    for doc, text in docs.select("doc_id", "text").collect():
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 2048)))
        assert all(r["length"] == 2048 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("caps", [
    packing.Capacities(100, 5, 10_000), packing.Capacities(100, 100, 10_000), packing.Capacities(100, 50, 12_000, (0.2, 1.0, 1.0)),
])
def test_packing_keeps_every_capacity(spark, caps):
    pieces = spark.range(3_000).selectExpr(
        "id as doc_id", "0 as piece", "if(id % 3 = 0, 7L, 1 + pmod(xxhash64(id), 100)) as length"
    )
    rows = packing.packed(pieces, caps).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 3_000
    n = check_places(rows, caps)
    lengths = [r["length"] for r in rows]
    least = max(sum(lengths) / caps.tokens, len(lengths) / caps.documents, sum(x * x for x in lengths) / caps.cost)
    assert n <= 1.1 * least + 1


def test_a_piece_beyond_a_capacity_is_an_error(spark):
    with pytest.raises(ValueError, match="exceeds"):
        packing.packed_histogram({11: 1}, packing.Capacities(10, 1, 100))


def test_packing_messy_documents_into_sequences(spark, messy, nothing, library):
    path = tokens.vocabulary_path(tokens.BYTE_BPE)
    cut = packing.pieces(messy, path, 2048, with_ids=True)
    placed = packing.packed(cut)
    assert check_places(placed.collect(), packing.Capacities()) >= 1
    own = [x for r in packing.sequences(placed).collect() for x in r["ids"]]
    wanted = [i for _, t in TEXTS for i in [*library[tokens.BYTE_BPE].encode(t or "", add_special_tokens=False).ids, 0]]
    assert sorted(own) == sorted(wanted)
    assert packing.packed_documents(nothing, path).count() == 0


# --- histogram sort -----------------------------------------------------------------------------------------


def check_shards(rows, shards):
    by = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert [r["slot"] for r in own] == list(range(len(own)))
    ends = [(min(r["doc_id"] for r in by[s]), max(r["doc_id"] for r in by[s])) for s in sorted(by)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


def test_shards_hold_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    size = F.octet_length(F.encode("text", "UTF-8")).cast("bigint") + 1
    sums = check_shards(sharding.sharded(docs, F.col("doc_id"), size).select("doc_id", "size", "shard", "slot").collect(), 8)
    assert max(sums) - min(sums) < 0.01 * sum(sums) / 8


def test_shards_of_few_rows_and_far_keys(spark, nothing):
    keys = [(-(2**63), 5), (2**63 - 1, 5), (0, 1_000), (1, 1)]
    df = spark.createDataFrame(keys, "doc_id bigint, n bigint")
    rows = sharding.sharded(df, F.col("doc_id"), F.col("n"), 3, 1).collect()
    assert len(rows) == 4
    check_shards(rows, 3)
    assert sharding.sharded(nothing, F.col("doc_id"), F.lit(1).cast("bigint")).count() == 0


def test_places_among_edges(spark):
    for edges in ([], [5], [-3, 5], [5, 5, 9], [*range(0, 70, 10)], [*range(0, 80, 10)]):
        rows = spark.range(-10, 100).select("id", sharding.place(F.col("id"), edges).alias("place")).collect()
        assert [r["place"] for r in rows] == [sum(e <= r["id"] for e in edges) for r in rows]


def test_larger_tables_get_more_ranges(spark, monkeypatch):
    docs = spark.range(0, 4_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n"))
    monkeypatch.setattr(sharding, "RANGE_BYTES", 40)
    cuts, parts = sharding.splitters(docs.select(F.col("doc_id").alias("__key"), F.col("n").alias("__size")), 8)
    assert parts == 50 and len(cuts) == 399 and cuts == sorted(cuts)
    sums = check_shards(sharding.sharded(docs, F.col("doc_id"), F.col("n")).collect(), 8)
    assert max(sums) - min(sums) <= 14


def test_a_key_with_a_third_of_the_bytes(spark):
    docs = spark.range(0, 3_000).select(F.greatest(F.col("id"), F.lit(1_000)).alias("doc_id"), F.lit(1).cast("bigint").alias("n"))
    rows = sharding.sharded(docs, F.col("doc_id"), F.col("n")).collect()
    assert len(rows) == 3_000
    check_shards(rows, 8)


def test_shards_of_messy_documents(messy):
    rows = sharding.sharded(messy, F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("bigint") + 1, 2, 2).collect()
    assert len(rows) == len(TEXTS)
    slots = sorted((r["shard"], r["slot"]) for r in rows)
    assert len(set(slots)) == len(slots)


def test_sharding_runs_no_python(spark, small):
    plan = sharding.op10_histogram_sort(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- WARC ---------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/ü?x=1\r\nX: y", "é" * 60), (2, None, "é" * 60), (3, "http://b", "short"), (4, "http://c", "short"), (5, "u", None),
    (6, "u", ""), (7, "u", "<p>" + LONG * 3), (7, "u", "<p>" + LONG * 3), (8, "u", "<p>" + LONG * 3), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 30),
    (None, "u", "é" * 60), (7, "v", "another payload under the same id " * 9), (10, "v", "another payload under the same id " * 9),
]


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 300)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("frame", F.lit("clash"))
    index = warc.write(pages, str(tmp_path))
    rows = warc.read(index).collect()
    wanted = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if p is not None and (h or "").encode() == data), default=page)
        again = page is not None and len(data) >= 100 and page > first
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None if again else data))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted((tuple(r[f] if f != "payload" or r[f] is None else bytes(r[f]) for f in fields) for r in rows), key=repr) == sorted(wanted, key=repr)
    one = warc.read(index.filter("page_id = 9")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == PAGES[9][2]


def test_bundles_are_plain_zstandard_too(spark, tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path))
    records = [warc.record(i, "u", b"x" * 9_000, None, False, "1970-01-01T00:00:00Z") for i in range(100)]
    places = [writer.add(r) for r in records]
    writer.close()
    with open(writer.uri, "rb") as file:
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(records)
    reader = warc.BundleReader(writer.uri)
    frame, offset = places[77]
    assert frame > 0 and reader.frame(frame)[offset:].startswith(records[77])
    reader.close()


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read(warc.write(pages, str(tmp_path))).count() == 0


# --- nearest neighbours -------------------------------------------------------------------------------------


def by_hand(rows, queries, k):
    out = {}
    for q, x in queries:
        scores = [(-sum(float(a) * float(b) for a, b in zip(x, y)), i) for i, y in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_searched_exactly(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4 + 1), 1.0, -float(i % 3)]) for i in range(60)]  # many equal vectors
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [nan, 1.0, 1.0]), (160, [inf, 1.0, 1.0]), (180, [None, 1.0, 1.0]), (200, [1.0]), (None, [1.0, 1.0, 1.0]), (220, [])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").withColumn("lists", F.lit("clash")).withColumn("list", F.lit(1))
    queries = [x for x in good if x[0] % 20 == 0]
    assert answers(nearest.nearest(df, df.filter("vec_id % 20 = 0"), 20)) == by_hand(good, queries, 20)
    assert answers(nearest.nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0"), 20)) == by_hand(good[:5], good[:1], 20)
    assert nearest.nearest(df.limit(0), df.limit(0), 20).count() == 0


def test_recall_over_lists_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 100)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = answers(nearest.nearest(df, df.filter("vec_id % 20 = 0"), 20))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    values = np.array([x for _, x in rows])
    hits = []
    for q, x in rows:
        if q % 20 == 0:
            order = np.argsort(-(values @ np.array(x)), kind="stable")
            wanted = [rows[i][0] for i in order if rows[i][0] != q][:20]
            hits.append(len(set(wanted) & {i for i, _ in found[q]}) / 20)
            assert len(found[q]) == 20
    assert np.mean(hits) > 0.93


def test_a_scan_without_slack_is_exact():
    chance = np.random.default_rng(1)
    values, query = chance.standard_normal((3_000, 48)), chance.standard_normal(48)
    blocks = [values[:, i : i + 16] for i in range(0, 48, 16)]
    order = np.argsort(((values - query) ** 2).sum(1))[:10]
    assert set(order) <= set(nearest.scan(query, blocks, 10, epsilon=50.0))
    assert len(set(order) & set(nearest.scan(query, blocks, 10, epsilon=2.1))) >= 9
