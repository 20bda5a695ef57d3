import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import parsing as I
from sluice.functions import scalars as N
from sluice.functions import text as X
from sluice.functions import tokenizer as K
from sluice.schema import bind as B
from sluice.schema.resolve import edit_distance, resolve


def one(spark, column, text="abcdef"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, X.replace_at("t", 2, 1, "-")) == "abc-def"
    assert one(spark, X.overlay_at("t", 2, 1, "-")) == "ab-def"
    assert one(spark, X.sub_part("t", 1, 3)) == "bc" and one(spark, X.sub_part("t", 1, 6)) is None
    assert one(spark, X.trim_part("t", 1, 1)) == "bcde" and one(spark, X.trim_start("t", 9)) == ""
    assert one(spark, X.contains_any("t", ["", "a"])) is False and one(spark, X.contains_any("t", ["a", ""])) is True
    assert one(spark, X.is_between("t", None, "f")) is False and one(spark, X.index_of("t", "z")) == -1
    assert one(spark, X.is_null_or_white_space("t"), " \t ") is True and one(spark, X.is_all_digits("t"), None) is False
    with pytest.raises(Exception, match="last index"):
        one(spark, X.last_idx("t"), "")


def test_scalars(spark):
    assert one(spark, N.round_half_even(F.lit(2.5))) == 2.0 and one(spark, N.round_half_up(F.lit(2.5))) == 3.0
    assert one(spark, N.int_div(F.lit(-7), 2)) == -3
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, N.add_or_update(m, "a", 2)) == {"a": 2} and one(spark, N.was_added(m, "b")) is True
    assert one(spark, N.get_or_null(m, "b")) is None
    with pytest.raises(Exception):
        one(spark, N.is_multiple(F.lit(1), 0))


def test_infer_options(spark):
    tag = lambda text, **o: one(spark, I.infer("t", I.ParseOptions(**o))["tag"], text)
    assert tag("1e5", double=True) == "double" and tag("1e5") == "string"
    assert tag("007", keep_leading_zeros=False) == "int" and tag("true", boolean=False) == "string"
    assert tag("x", custom_first=lambda t: (t == "x", F.lit("mine"))) == "mine"
    assert one(spark, I.try_infer("t"), "7") is True
    with pytest.raises(Exception):
        one(spark, I.parse_as("t", "int"), "seven")


def test_tokenizer_rules():
    t = K.Tokenizer(r"(?P<num>\d+)", r"([a-z])x")
    assert t.tokens("a1b22") == [(K.UNMATCHED_SLICE, "a"), ("num", "1"), (K.UNMATCHED_SLICE, "b"), ("num", "22")]
    assert t.tokens("ax") == [("1", "a"), (K.UNMATCHED_SLICE, "x")] and t.tokens("??") == [(K.UNMATCHED_LINE, "??")]
    with pytest.raises(ValueError):
        K.Tokenizer(r"((a)b)").tokens("ab")
    assert K.many(K.NUM) == r"\d+" and K.many("ab", 1, 2) == "(?:ab){1,2}" and K.one_of("a", "b") == "[ab]"
    assert K.maybe("ab") == "(?:ab)?" and K.as_("x", "n") == "(?P<n>x)" and K.one_of("ab", "c") == "ab|c"


def test_tokens_by_group(spark):
    t = K.Tokenizer(r"(?P<num>\d+)")
    df = spark.createDataFrame([("a1",)], "line string").select(t.tokenize(F.col("line")).alias("t"))
    with pytest.raises(Exception, match="no selector"):
        df.select(K.select_case_by_group(F.col("t"), {"num": lambda s: s})).collect()
    both = {"num": lambda s: F.concat(s, s), K.UNMATCHED_SLICE: lambda s: s}
    got = df.select(K.select_case_by_group(F.col("t"), both).alias("t")).first()["t"]
    assert [r["subpart"] for r in got] == ["a", "11"]


def test_resolver():
    assert resolve(["Id", "customer name", "AMOUNT", "emial"], ["id", "customer_name", "amount", "email", "other"]) == {
        "Id": "id", "customer name": "customer_name", "AMOUNT": "amount", "emial": "email",
    }
    assert resolve(["zzz"], ["amount"]) == {} and edit_distance("kitten", "sitting") == 3
    assert resolve(["order"], ["order_total", "order_id"]) == {"order": "order_id"}


def test_bind(spark):
    schema = T.StructType([
        T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType(), True, {B.ALLOWED: ["Vip", "Regular"]}), T.StructField("ok", T.BooleanType()),
        T.StructField("amount", T.DecimalType(10, 2)), T.StructField("tags", T.ArrayType(T.IntegerType())), T.StructField("gone", T.StringType()),
    ])
    df = spark.createDataFrame([("", "VIP", "1", "1.234,50", "[1,2]"), ("7", "zz", "no", "x", "?")], "ID string, Kind string, Ok string, Amount string, Tags string")
    a, b = B.bind(df, schema).collect()
    assert (a["id"], a["kind"], a["ok"], float(a["amount"]), a["tags"], a["gone"]) == (0, "Vip", True, 1234.5, [1, 2], None)
    assert (b["id"], b["kind"], b["ok"], b["amount"]) == (7, None, None, None)
    ordered = T.StructType([T.StructField("b", T.IntegerType(), True, {B.ORDER: 1}), T.StructField("a", T.IntegerType(), True, {B.ORDER: 0})])
    assert B.bind_ordered(spark.createDataFrame([("1", "2")], "x string, y string"), ordered).first().asDict() == {"b": 2, "a": 1}
    fed = B.feed(spark.createDataFrame([(1, "q")], "user_id int, name string"), {"UserId": F.lit(5)})
    assert fed.first()["user_id"] == 5


def test_queries_of_all_texts(spark, tmp_path):
    from sluice.plans.catalogue import QUERIES

    texts = ["", "T.", "Tabcd", "abcdefg", "abcdefgh", "Of the long ones.", "x the y"]
    rows = [(7 * k, t, "de" if k % 2 else "en") for k, t in enumerate(texts)] + [(1, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in run("string_helpers")}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        r = got[7 * k]
        assert (r["replaced"], r["part"], r["last"]) == (t[:4] + "##" + t[5:], t[2:7] if len(t) > 7 else None, len(t) - 1 if t else None)
        assert r["between"] == (t.startswith("T") and t.endswith("."))
    # A null text has no lines, but its separator; all others are split, those of ids that 7 divides too.
    want = [(7 * k, i, x) for k, t in enumerate(texts) for i, x in enumerate([*t.split("\n"), "--"])] + [(1, 0, "--")]
    assert sorted((r["doc_id"], r["index"], r["item"]) for r in run("flatten_separator")) == sorted(want)
    assert sorted((r["doc_id"], r["line"]) for r in run("to_lines")) == [(35, "Of"), (42, "x")]
