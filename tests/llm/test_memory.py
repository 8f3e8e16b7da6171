"""What a Python worker holds: one operator's memo at a time, batches of bounded size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rebuy.llm import common, near_join, packing, tokens
from tests.llm.helpers import docs_table

LENGTH = 1 << 20


def test_a_worker_keeps_one_memo():
    held = common.worker_state("memo", dict)
    held.clear()
    near_join.shingle_set("some words of a text")
    assert list(held) == ["word-hashes"] and len(held["word-hashes"]) == 5
    path = tokens.default_vocabulary()
    first = tokens.encoder(path)
    assert list(held) == [f"encoder:{path}"] and tokens.encoder(path) is first
    near_join.shingle_set("some words of a text")
    assert list(held) == ["word-hashes"]


def test_batches_for_python_are_bounded(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs_table(spark, [(i, chr(97 + i % 26) * LENGTH) for i in range(24)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.table(spark, str(tmp_path), "documents").coalesce(1).select("text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 24 and max(found) * LENGTH <= common.BATCH_BYTES + LENGTH
    spark.conf.set(name, "1m")
    common.table(spark, str(tmp_path), "documents")
    assert spark.conf.get(name) in ("1m", str(1 << 20))
    spark.conf.set(name, str(common.BATCH_BYTES))


def test_pieces_with_and_without_ids(spark):
    rows = [(1, None), (2, ""), (3, "one two three " * 400), (None, "x"), (3, "one two")]
    library = Tokenizer.from_file(tokens.default_vocabulary())
    wanted = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 100)):
            part = ids[at : at + 100]
            wanted.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    docs = docs_table(spark, rows)
    whole = [tuple(r) for r in packing.pieces(docs, tokens.default_vocabulary(), 0, 100, with_ids=True).collect()]
    plain = [tuple(r) for r in packing.pieces(docs, tokens.default_vocabulary(), 0, 100).collect()]
    order = lambda r: (str(r[0]), r[1], r[2], r[3], r[4])
    assert sorted(whole, key=order) == sorted(wanted, key=order)
    assert sorted(plain, key=order) == [r[:5] for r in sorted(wanted, key=order)]


def test_batches_of_several_chunks(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 64)
    texts = ["Ab ÉC, dé " * (1 + i % 7) + "한" * (i % 3) if i % 5 else None for i in range(60)]
    encoder, library = tokens.Encoder(tokens.default_vocabulary()), Tokenizer.from_file(tokens.default_vocabulary())
    found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.texts(pa.array(texts))]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
