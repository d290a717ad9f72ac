import math

from pyspark.sql import functions as F

from crawlscope.functions import text as X
from crawlscope.operators.content import mask_texts

# (text, masked, hits by kind: email phone resident card secret bearer)
MASKED = [
    ("Reach user@example.com or 010-1234-5678, 01012345678.", "Reach ***@***.*** or ***-****-****, ***-****-****.", (1, 2, 0, 0, 0, 0)),
    ("id 900101-1234567 and 9202021234567 end", "id ******-******* and ******-******* end", (0, 0, 2, 0, 0, 0)),
    ("card 4111 1111 1111 1111 é next", "card ****-****-****-****é next", (0, 0, 0, 1, 0, 0)),
    ("4222-2222-2222-2222, 42222222222222223333", "****-****-****-****, 42222222222222223333", (0, 0, 0, 1, 0, 0)),
    ('"Access-Token" = "x" CLIENT_SECRET="y"', '"Access-Token" = "***REDACTED***" CLIENT_SECRET="***REDACTED***"', (0, 0, 0, 0, 2, 0)),
    ("Bearer abc.def-ghi+/== and BEARER x, tokenBearer no", "Bearer ***REDACTED***+/== and Bearer ***REDACTED***, tokenBearer no", (0, 0, 0, 0, 0, 2)),
    ("digits 2234567890223é", "digits 2234567890223é", (0, 0, 0, 0, 0, 0)),
    ("٢٢٣٤٥٦٧٨٩٢٢٢٣ arabic digits", "****-****-****-****arabic digits", (0, 0, 0, 1, 0, 0)),
    ("nothing here", "nothing here", (0, 0, 0, 0, 0, 0)),
    ("", "", (0, 0, 0, 0, 0, 0)),
]
KINDS = "email phone resident card secret bearer".split()


def test_masking_of_written_out_pairs(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(MASKED)], "id int, text string")
    for row in mask_texts(df, ["id"]).collect():
        _, masked, hits = MASKED[row.id]
        assert row.masked == masked
        assert tuple(row[f"{kind}_hits"] for kind in KINDS) == hits, masked


def test_masking_documents_leaves_nothing_to_mask(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    once = docs.select("text", X.mask_pii(F.col("text")).alias("masked"))
    changed = 0
    for text, masked, again in once.select("text", "masked", X.mask_pii(F.col("masked"))).collect():
        assert masked == again
        assert "@" not in masked.replace("***@***", "")
        changed += masked != text
    assert 0 < changed < docs.count()


def test_preview_cuts_after_masking(spark):
    text = "a@b.co " + "x" * 3000
    df = spark.createDataFrame([(text,), ("short a@b.co",)], "t string")
    got = [r[0] for r in df.select(X.preview(F.col("t"))).collect()]
    masked = "***@***.*** " + "x" * 3000
    assert got == [masked[:2000] + "... (truncated)", "short ***@***.***"]


def test_words_minutes_and_colors(spark):
    df = spark.createDataFrame([("a b\n c d",), ("",), ("w " * 401,)], "t string")
    words = [r[0] for r in df.select(X.word_count(F.col("t"))).collect()]
    assert words == [4, 0, 401]
    minutes = [r[0] for r in df.select(X.reading_minutes(X.word_count(F.col("t")))).collect()]
    assert minutes == [max(1, math.ceil(w / 200)) for w in words]
    colors = spark.createDataFrame([("rgb(1, 22,255)",), ("rgba(0, 0, 0, .5)",), ("#fff",), (" rgb(1,2,3)",)], "c string")
    assert [r[0] for r in colors.select(X.rgb_to_hex(F.col("c"))).collect()] == ["#0116FF", "#000000", "#fff", " rgb(1,2,3)"]


def test_json_string(spark):
    value = 'a"b\\c\né/'
    df = spark.createDataFrame([(value,)], "t string")
    import json

    assert df.select(X.json_string(F.col("t"))).first()[0] == json.dumps(value, ensure_ascii=False)
