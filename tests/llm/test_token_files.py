import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martwright.llm import queries
from martwright.llm.common import open_store
from martwright.llm.token_files import read_token_files, write_token_files

PATH = queries.tokenizer()


def plain(rows, end=0):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    enc = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    for i, ids in sorted(enc, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], dtype="<u2").tobytes())):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def said(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in
                   df.withColumn("ids_crc32", F.crc32("ids_u32")).collect()), key=lambda r: r[1])


def test_query(spark, small, documents):
    got = sorted(map(tuple, queries.op5(spark, small).collect()))
    assert got == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows_and_one_file(spark, odd):
    folder = write_token_files(odd, PATH, files=1)
    assert said(read_token_files(spark, folder)) == plain([(r.doc_id, r.text) for r in odd.collect()])


def test_files_hold_what_the_manifest_says(spark, documents):
    folder = write_token_files(documents, PATH, files=5)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("_range").collect()
    assert len(files) > 1
    fs, path = open_store(folder)
    base = 0
    for f in files:
        ids = np.frombuffer(fs.open_input_file(f"{path}/{f.bin}").read(), dtype="<u2")
        off = np.frombuffer(fs.open_input_file(f"{path}/{f.off}").read(), dtype="<i8")
        assert f.width == 2 and f.base == base and len(ids) == f.tokens == off[-1] and len(off) == f.docs + 1
        base += f.tokens


def test_empty(spark, empty):
    assert read_token_files(spark, write_token_files(empty, PATH)).count() == 0
