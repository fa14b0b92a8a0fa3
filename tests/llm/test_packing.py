import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablelens.llm.packing import Encoder, cut, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b ", "it's we'LL I'd 12x3", "<|endoftext|> a<|startoftext|>b", "Straße ÀÉÎß éa ß### ß", "é café İstanbul ΣΑΣ",
    "a b c\x1cd\x85e", "中文字 日本", "ﬁ ½ ² ª º µ", "x\ty\r\nz\x0bq\x0cr", "👍🏽 ok", "́abc", "Ǆ ǆ Ÿ ÿ", "\x00 nul", "don't***###!!",
]


@pytest.mark.parametrize("tokens", [1, 2, 5, 682, 683, 684, 1023, 1024, 1025, 1300, 2047, 2048, 2049, 9999])
def test_cuts_cover_and_nearly_fill_their_share(tokens):
    pieces = cut(tokens)
    assert sum(pieces) == tokens and all(0 < p <= 2048 for p in pieces)
    assert all(2048 - 2048 // p * p <= 0.02 * 2048 for p in pieces)


def test_ids_equal_the_tokenizer(spark):
    whole = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = Encoder(PATH)
    assert encoder.cuts
    for ids, text in zip(encoder.encode(pa.array(texts)), texts):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]
    encoder.cuts = False
    assert [i.tolist() for i in encoder.encode(pa.array(ODD))] == [i.tolist() for i in Encoder(PATH).encode(pa.array(ODD))]


def check(rows, texts):
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    bins, docs = defaultdict(list), defaultdict(list)
    for row in rows:
        own = ids[row.doc_id]
        assert row.ids_crc32 == zlib.crc32(own[row.start : row.start + row.length].tobytes()) and row.doc_tokens == len(own)
        bins[row.sequence_id].append((row.offset, row.length))
        docs[row.doc_id].append((row.start, row.length))
    for spans, size in [(v, None) for v in bins.values()] + [(v, len(ids[i])) for i, v in docs.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 2048 if size is None else at == size
    assert docs.keys() == ids.keys()
    return sum(map(len, ids.values())) / (2048 * len(bins))


def test_given_documents_are_packed_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fill = check(pack(docs.repartition(6)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert fill > 0.97


def test_odd_rows_and_ids(frame):
    random.seed(2)
    texts = list(enumerate(ODD + [None] + ["word " * random.randrange(3000) for _ in range(20)]))
    table = frame([(i, t, 1) for i, t in texts], "doc_id long, text string, share int")
    check(pack(table).collect(), texts)
    rows = pack(table, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    twice = pack(table.where("doc_id = 3").unionByName(table.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert pack(table.limit(0)).count() == 0
