from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.functions import parsing as ps
from tidemark.operators.infer import relevance_labels


def each(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(column(F.col("t"))).collect()]


def test_slash_dates(spark):
    got = each(spark, ["2023/05/08 (Mon) 00:05", "2023/12/31 (Sun) 12:30", "2023/02/30 (x) 23:59", "2023-05-08", None, "2023/13/01 (x) 01:00"],
               dt.parse_slash_date)
    assert tuple(got[0]) == ("2023-05-08T00:05:00.000Z", "12:05 am on 8 May, 2023")
    assert tuple(got[1]) == ("2023-12-31T12:30:00.000Z", "12:30 pm on 31 December, 2023")
    assert got[2][0] == "2023-03-02T23:59:00.000Z"
    assert got[3:] == [None, None, None]


def test_clock_dates(spark):
    got = each(spark, ["1:56 pm on 8 May, 2023", "12:00 AM on 1 jan 2024", "12:15 pm on 3 Sept, 2022", "9:00 am on 2 Foo, 2022", "soon"],
               dt.parse_clock_date)
    assert tuple(got[0]) == ("2023-05-08T13:56:00.000Z", "1:56 pm on 8 May, 2023")
    assert tuple(got[1]) == ("2024-01-01T00:00:00.000Z", "12:00 am on 1 jan, 2024")
    assert got[2][0] == "2022-09-03T12:15:00.000Z"
    assert got[3:] == [None, None]


def test_dates_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = each(spark, ["2023/03/12 (Sun) 02:30"], dt.parse_slash_date)[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == "2023-03-12T02:30:00.000Z"


def test_date_of(spark):
    assert each(spark, ["2024-01-02T03:04", "", None, "2024"], dt.date_of) == ["2024-01-02", "unknown", "unknown", "2024"]


def test_verdicts(spark):
    texts = [
        '```json\n{"score": 1, "label": "correct", "explanation": "ok"}\n```',
        '{"score": 1} and {"score": 0}',
        '{"score": true, "label": "correct"}',
        '{"score": 1.0, "label": "other"}',
        'the answer is "correct"',
        '"correct" or "incorrect"',
        '{"score": "1"}',
    ]
    got = [tuple(r) for r in each(spark, texts, ps.parse_verdict)]
    failed = "Failed to parse judge response"
    assert got == [
        (1, "correct", "ok"), (0, "incorrect", failed), (0, "correct", ""), (1, "incorrect", ""),
        (1, "correct", failed), (0, "incorrect", failed), (0, "incorrect", ""),
    ]


def test_rubric_precedence(spark):
    got = each(spark, ["temporal-adversarial", "Temporal-update", "changing-preference", "user-preference", "multi"], ps.judge_rubric)
    assert got == ["abstention", "temporal", "update", "preference", "default"]


def test_extraction(spark):
    text = (
        "<memories>\n[2024-01-02] a\n\nb\n</memories><entities>\nAnn|person|likes|tea\nbad|line\n|x|y\nBo | org | big\n</entities>"
        "<relationships>\nAnn|knows|Bo|2024\nAnn|likes|Tea|\nx|y\n</relationships>"
    )
    lines = each(spark, [text], ps.memory_lines)[0]
    assert [tuple(x) for x in lines] == [("[2024-01-02] a", "2024-01-02"), ("b", None)]
    assert [tuple(x) for x in each(spark, [text], ps.entity_lines)[0]] == [("Ann", "person", "likes|tea"), ("Bo", "org", "big")]
    assert [tuple(x) for x in each(spark, [text], ps.relationship_lines)[0]] == [("Ann", "knows", "Bo", "2024"), ("Ann", "likes", "Tea", None)]
    bare = "fact one\n<entities>\na|b|c\n</entities>\nfact two"
    assert [x[0] for x in each(spark, [bare], ps.memory_lines)[0]] == ["fact one", "fact two"]


def test_relevance_labels(spark, rows):
    df = spark.createDataFrame([(1, 'x [{"id":"result_1","relevant":1},{"id":"result_2","relevant":3}]'), (2, "[oops"), (3, '[{"id":"a","relevant":1}] or []')], "query_id int, reply string")
    assert rows(relevance_labels(df)) == [(1, "result_1", 1), (1, "result_2", 0)]


def test_template(spark):
    df = spark.createDataFrame([("a $1 {{context}}", None, "ctx")], "q string, d string, c string")
    got = df.select(ps.fill_template(F.lit("{{question}}|{{questionDate}}|{{context}}|{{question}}"), F.col("q"), F.col("d"), F.col("c"))).first()[0]
    assert got == "a $1 ctx|Not specified|{{context}}|{{question}}"
