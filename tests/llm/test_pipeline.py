"""The pipeline against the same stages done by hand on a small table."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from checks.compare import duck
from tests.llm.conftest import TEXTS
from tests.llm.test_text_operators import base_by_hand, groups_by_hand, words
from tests.llm.test_token_operators import check_places
from tradewind.llm import packing, secrets, tokens
from tradewind.llm.queries import oracle_sql


def without_repeats_by_hand(rows):
    first = {}
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - 12):
            key = tuple(own[i : i + 13])
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - 12):
            if first[tuple(own[i : i + 13])] < doc:
                gone[i : i + 13] = [True] * 13
        out[doc] = b" ".join(w for w, g in zip(own, gone) if not g).decode() if any(gone) else text
    return out


def test_stages_by_hand(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stored = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        stored.append(docs)
    for table in stored[:-1]:
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = [{r["doc_id"]: r["text"] for r in table.collect()} for table in stored[:-1]]

    columns, rows = duck(oracle_sql()["op2_quality_rules"], small)
    kept = {r[columns.index("doc_id")] for r in rows if r[columns.index("kept")]}
    assert found[0] == {d: t for d, t in texts.items() if d in kept}

    groups = groups_by_hand(sorted(found[0].items()))
    assert found[1] == {d: found[0][d] for d, _, least in groups if d == least}

    assert found[2] == without_repeats_by_hand(sorted(found[1].items()))

    field = secrets.fitted(stored[2])
    scanner = secrets.Scanner(field)
    for doc, text in found[2].items():
        base, spans = scanner.spans(text)
        assert base == base_by_hand(text)
        hidden, at = "", 0
        for start, end, _ in sorted(spans):
            hidden += text[at:start] + "[secret]" if start >= at else ""
            at = max(at, end)
        assert found[3][doc] == hidden + text[at:]

    placed = stored[4].collect()
    check_places(placed, packing.Capacities())
    theirs = Tokenizer.from_file(tokens.vocabulary_path(tokens.BYTE_BPE))
    lengths = {}
    for r in placed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for d, t in found[3].items()}
    assert np.isfinite(sum(lengths.values()))


def test_stages_of_messy_and_empty_documents(spark, messy, nothing, tmp_path):
    for name, table in (("messy", messy), ("nothing", nothing)):
        docs = table
        for i, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{i}")
        assert docs.count() <= len(TEXTS) + 40
        assert (docs.count() == 0) == (name == "nothing")
