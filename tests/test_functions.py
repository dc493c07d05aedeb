"""Functions against hand-computed values and plain versions of themselves."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.errors import ConfigError, FingerprintMismatch
from tessella.functions import fingerprint, text, vector


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [("中文乱码", "中文 文乱 乱码"), ("导出 CSV 中文乱码", "导出 CSV 中文 文乱 乱码"), ("中", "中"), ("plain words", "plain words"), ("", ""), ("a中文b", "a 中文 b")],
)
def test_bigrams(spark, given, want):
    assert one(spark, text.cjk_bigram(F.lit(given))) == want
    assert text.py_cjk_bigram(given) == want


def test_bigrams_equal_the_plain_version_on_random_strings(spark):
    rng = random.Random(5)
    alphabet = list("ab1.- \t") + list("中文乱码导出かなア") + ["𠀀", "𠀁", "한", "é"]
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))),) for _ in range(800)]
    got = spark.createDataFrame(rows, "t string").select("t", text.cjk_bigram(F.col("t")).alias("b")).collect()
    assert [(r.t, r.b) for r in got if r.b != text.py_cjk_bigram(r.t)] == []


def test_embedded_text(spark):
    none = F.array().cast("array<struct<author:string,body:string>>")
    assert one(spark, text.build_text_with_comments(F.lit(" 标题 "), F.lit("正文"), none)) == "标题\n标题\n正文"
    assert one(spark, text.build_text(F.lit("t"), F.lit(" body"), 2, 3)) == "t\nt\n bo"
    talk = F.array(*[F.struct(F.lit(a).alias("author"), F.lit(b).alias("body")) for a, b in (("x", "long" * 200), ("dbx[bot]", "no"), ("y", "z"))])
    made = one(spark, text.build_text_with_comments(F.lit("t"), F.lit("b"), text.without_bots(talk), quota=510))
    assert made == "t\nt\nb\n\n[讨论]\n- x " + "long" * 125 + "\n- y z"


def test_images(spark):
    given = "see ![a](http://x/y) and https://h/i.PNG?x=1 but https://h/page"
    assert one(spark, text.strip_image_links(F.lit(given))) == "see [图片] and [图片] but https://h/page"


def test_title_similarity(spark):
    s = lambda a, b: one(spark, text.title_similarity(F.lit(a), F.lit(b)))
    assert s("login loop", "Login LOOP") == 1.0
    assert s("a a b", "a b b") == pytest.approx(2 / 3)
    assert s("", "x") == 0.0
    assert s("x", "y") == 0.0


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, vector.dot(v(1, 2), v(3, 4))) == 11.0
    assert one(spark, vector.l2_normalise(v(3, 4))) == [0.6, 0.8]
    assert one(spark, vector.l2_normalise(v(0, 0))) == [0.0, 0.0]
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vector.dot(v(1), v(1, 2)))
    back = spark.range(1).select(vector.encode_f32(v(0.5, -2).cast("array<float>")).alias("b")).select(vector.decode_f32(F.col("b")).alias("v"))
    assert back.first()[0] == [0.5, -2.0]


def test_fingerprints():
    fp = fingerprint.full("m[dim=4]|api|len=512")
    assert fingerprint.ensure(None, fp) == fp
    assert fingerprint.ensure("m[dim=4]|api|len=512", fp) == fp
    with pytest.raises(FingerprintMismatch):
        fingerprint.ensure(fingerprint.full("other|api|len=512"), fp)
    with pytest.raises(ConfigError):
        fingerprint.ensure(fingerprint.full("m[dim=4]|api|len=512", 3), fp)
    with pytest.warns(UserWarning):
        assert fingerprint.ensure(fingerprint.full("m[dim=4]|onnx|len=512"), fp) == fingerprint.full("m[dim=4]|onnx|len=512")


def test_bm25_equals_fts5(spark):
    from tessella.operators import bm25

    rng = random.Random(2)
    words = ["login", "Café", "cafe", "crash", "v1.2", "foo-bar", "foo", "bar", "naïve", "a_b", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(1, 80)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body)")
    db.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", docs)
    index = bm25.build(spark.createDataFrame(docs, "id long, title string, body string"))
    for query in ("login", "cafe crash", "foo-bar", "the the", "missing", "a_b login", "!!"):
        got = {r.id: r.bm25 for r in bm25.score(index, query).collect()}
        match = " ".join('"%s"' % w for w in query.split() if any(c.isalnum() for c in w))
        want = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall()) if match else {}
        assert got.keys() == want.keys(), query
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got), query
