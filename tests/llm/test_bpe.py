import random
import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorumlens.llm.bpe import ByteBpe, decode, encode, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(4)
    parts = ["the", " The", "tion", "é", "ß", "²", "½", "\xa0", "\x85", "\x1c", "  ", "\n", "\t\n ", "don't", "'ll", "<|endoftext|>", "😀", "日本語", "123", "٣", "_", "!!", "***", "ŉ", "İ", "Σ", "​", "　", "á"]
    return ["", "x" * 20_000, "ab" * 5_000, " " * 3000] + ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(1500)]


def test_equal_to_the_library():
    library, own = Tokenizer.from_file(PATH), ByteBpe(PATH)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        packed = own.encode(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, t
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)
    odd = [[0, 255, 188], [50256, 10, 200, 201, 202], [99999]]
    for ids in odd[:2]:
        assert own.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(struct.pack("<I", 99999)) == ""


def test_columns(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "a b", 2), (2, "a b", 2), (3, "", 0)], "doc_id long, text string, ids int")
    out = docs.withColumn("packed", encode(F.col("text"), PATH)).withColumn("back", decode(F.col("packed"), PATH)).collect()
    assert [x["back"] for x in out] == ["", "a b", "a b", ""] and len(out[1]["packed"]) == 8
    both = docs.select(round_trip(F.col("text"), PATH).alias("r")).select("r.*").collect()
    assert [(x["ids"], x["decoded"]) for x in both] == [(x["packed"], x["back"]) for x in out]
    assert docs.filter("doc_id > 9").select(encode(F.col("text"), PATH)).count() == 0
