"""Golden values of the dialect's functions."""

import datetime
import math

from pyspark.sql import functions as F

from siltstone.functions import aggregate as A
from siltstone.functions import scalar as S

L = F.lit
D = lambda s: F.lit(s).cast("date")
TS = lambda s: F.lit(s).cast("timestamp_ntz")


def cases():
    NULL = F.lit(None).cast("int")
    return [
        (S.elt(L(2), L("a"), L("b")), "b"), (S.elt(L(5), L("a")), None), (S.elt(L(0), L("a")), None),
        (S.field(L("b"), L("a"), L("b")), 2), (S.field(F.lit(None).cast("string"), L("a")), 0),
        (S.make_set(L(5), L("a"), L("b"), L("c")), "a,c"), (S.make_set(NULL, L("a")), None), (S.make_set(L(0), L("a")), ""),
        (S.export_set(L(5), L("Y"), L("N"), ",", 4), "Y,N,Y,N"),
        (S.interval_index(L(23), L(1), L(15), L(17), L(30)), 3), (S.interval_index(NULL, L(1)), -1),
        (S.insert(L("Quadratic"), L(3), L(4), L("What")), "QuWhattic"), (S.insert(L("Quadratic"), L(-1), L(4), L("What")), "Quadratic"),
        (S.insert(L("Quadratic"), L(3), L(100), L("What")), "QuWhat"),
        (S.trim_whole(L("barxxyz"), "xyz", "trailing"), "barx"), (S.trim_whole(L("xxxbarxxx"), "x", "leading"), "barxxx"),
        (S.mid(L("abc"), L(0), L(2)), ""), (S.mid(L("abc"), L(-2), L(1)), "b"), (S.ord_(L("é")), 0xC3A9), (S.ord_(L("")), 0),
        (S.quote(L("Don't")), "'Don\\'t'"), (S.quote(F.lit(None).cast("string")), "NULL"),
        (S.strcmp(L("a"), L("b")), -1), (S.strcmp(L("a"), L("A ")), 0), (S.strcmp(L("a"), L("A"), True), 1), (S.strcmp(F.lit(None).cast("string"), L("a")), None),
        (S.int_divide(L(9007199254740993), L(1)), 9007199254740993), (S.int_divide(L(-7), L(2)), -3), (S.int_divide(L(7), L(0)), None), (S.int_divide(L(7.5), L(2.0)), 3),
        (S.truncate(L("0.29").cast("decimal(10,2)"), 2).cast("string"), "0.29"), (S.truncate(L(-1.999), 1).cast("string"), "-1.9"), (S.truncate(L(122), -2).cast("int"), 100),
        (S.cast_time(L("1 02:03:04")), "26:03:04"), (S.cast_time(L("10:11")), "10:11:00"), (S.cast_time(L("-101112")), "-10:11:12"), (S.cast_time(L("2001-02-03 04:05:06.7")), "04:05:06"),
        (S.cast_time(L("x")), None), (S.cast_time(L("10:61:00")), None), (S.cast_time(L("900:00:00")), "838:59:59"),
        (S.cast_datetime(L("2001-2-3")), datetime.datetime(2001, 2, 3)), (S.cast_datetime(L("20010203040506")), datetime.datetime(2001, 2, 3, 4, 5, 6)),
        (S.cast_datetime(L("2001/02/03 04.05")), datetime.datetime(2001, 2, 3, 4, 5)), (S.cast_datetime(L("2001-02-30")), None),
        (S.str_to_date(L("01,5,2013"), "%d,%c,%Y"), datetime.datetime(2013, 5, 1)), (S.str_to_date(L("May 1, 2013"), "%M %e, %Y"), datetime.datetime(2013, 5, 1)),
        (S.str_to_date(L("9:30:17"), "%k:%i:%s"), datetime.datetime(1970, 1, 1, 9, 30, 17)), (S.str_to_date(L("a09"), "a%H"), datetime.datetime(1970, 1, 1, 9)), (S.str_to_date(L("z"), "%d"), None),
        (S.str_to_date(L("it's at 09 of 7/2/2001"), "it's at %H of %e/%c/%Y"), datetime.datetime(2001, 2, 7, 9)),
        (S.timediff(TS("2000-12-31 23:59:59"), TS("2000-12-30 01:01:01")), "46:58:58"), (S.timediff(TS("2000-01-01 00:00:00"), TS("2000-01-01 00:00:01")), "-00:00:01"),
        (S.utc_timestamp(TS("2001-02-03 00:30:00"), "+01:00"), datetime.datetime(2001, 2, 2, 23, 30)), (S.utc_date(TS("2001-02-03 00:30:00"), "+01:00"), datetime.date(2001, 2, 2)),
        (S.charset(L("a")), "utf8"), (S.charset(L(1)), "binary"), (S.collation(L("a")), "UTF8_BINARY"), (S.soundex(L("Quadratically")), "Q36324"), (S.soundex(L("Hello")), "H400"), (S.sounds_like(L("Robert"), L("Rupert")), 1),
        (S.char_of(L(77), L(121), NULL, L(83)), "MyS"), (S.convert_using(L("aé"), "ascii"), "a?"),
        (S.regexp(L("Monty!"), "^mo.*[[:punct:]]$"), 1), (S.regexp(L("a"), "A", binary=True), 0), (S.regexp(L("a word"), "[[:<:]]word[[:>:]]"), 1),
        (S.like(L("David!"), "DAVID_"), 1), (S.like(L("a%"), "A|%", escape="|"), 1), (S.like(L("ab"), "a|%", escape="|", binary=True), 0), (S.like(L("a_b"), "A\\_B"), 1),
        (S.make_time(L(12), L(15), L(30)), 44130), (S.make_time(L(-1), L(0), L(1)), -3601), (S.make_time(L(1), L(60), L(0)), None), (S.make_time(L(900), L(0), L(0)), 3020399),
        (S.add_time(L(3600), L(60), -1), 3540), (S.add_time(L(3020399), L(1)), 3020399), (S.add_time(NULL, L(1)), None),
        (S.time_format(L(100 * 3600), "%H %k %h %I %l"), "100 100 04 04 4"), (S.time_format(L(3661), "%r"), "01:01:01 AM"), (S.time_format(NULL, "%H"), None),
        (S.time_format(L(-3661), "%T"), "-01:01:01"), (S.extract("year_month", TS("2019-07-02 01:02:03")), 201907), (S.extract("day_minute", TS("2019-07-02 01:02:03")), 20102),
        (S.extract("second_microsecond", TS("2019-07-02 01:02:03.000123")), 3000123), (S.extract("quarter", TS("2019-07-02")), 3), (S.like(L("abc"), "ABC", binary=True), 0), (S.equal_text(L("a"), L("A ")), 1),
        (S.number_prefix(L(" 12.5abc")), 12.5), (S.number_prefix(L("abc")), 0.0),
        (S.divide(L(8), L(5)).cast("string"), "1.6000"), (S.divide(L(1), L(7), 3).cast("string"), "0.143"), (S.divide(L(1), L(0)), None),
        (S.int_divide(L(-7), L(2)), -3), (S.modulo(L(8), L(5)), 3), (S.modulo(L(8), L(0)), None),
        (S.shift_left(L(1), 63).cast("string"), "9223372036854775808"), (S.shift_left(L(1), 64).cast("int"), 0), (S.shift_right(L(4), 63).cast("int"), 0),
        (S.bit_or(L(-1), L(0)).cast("string"), "18446744073709551615"), (S.bit_and(L(-1), L(1)).cast("int"), 1),
        (S.shift_right(L(-1), 1).cast("string"), "9223372036854775807"), (S.bit_not(L(0)).cast("string"), "18446744073709551615"),
        (S.truncate(L(-1.999), 1), -1.9), (S.clamp_int(L("127.6"), -128, 127).cast("int"), 127), (S.clamp_int(L("-0.5"), -128, 127).cast("int"), -1),
        (S.greatest(L(1), NULL), None), (S.least(L(1), L(2)), 1), (S.xor(L(1), L(0)), 1), (S.truth(NULL, "unknown"), 1), (S.truth(NULL, "not true"), 1),
        (S.date_format(TS("2009-10-04 22:23:00"), "%W %M %Y"), "Sunday October 2009"), (S.date_format(TS("2007-10-04 22:23:00"), "%H:%i:%s"), "22:23:00"),
        (S.date_format(TS("1999-01-01"), "%D %w %%"), "1st 5 %"), (S.date_format(TS("2005-03-11"), "%D"), "11th"),
        (S.to_days(D("1970-01-01")), 719528), (S.from_days(L(719529)), datetime.date(1970, 1, 2)),
        (S.period_add(L(9801), L(2)), 199803), (S.period_diff(L(9802), L(199703)), 11), (S.yearweek(D("1987-01-01"), 0), 198652),
        (S.time_of(L("300:55:50")) > S.time_of(L("240:00:00")), True), (S.time_of(L("-01:00:00")), -3600), (S.time_of(L("09:00:00")), 32400), (S.time_of(L("x")), None),
        (S.sec_to_time(L(2378)), "00:39:38"), (S.sec_to_time(L(10**8)), "838:59:59"), (S.sec_to_time(L(-3661)), "-01:01:01"),
        (S.add_interval(TS("2006-09-26"), L(1), "day").cast("string"), "2006-09-27 00:00:00"), (S.add_interval(TS("2006-09-26"), L(1), "week").cast("string"), "2006-10-03 00:00:00"),
        (S.add_interval(TS("2006-09-26"), L(1), "month").cast("string"), "2006-10-26 00:00:00"), (S.add_interval(TS("2000-01-01"), L(8000), "year"), None),
        (S.year_of_two_digits(L(69)), 2069), (S.year_of_two_digits(L(70)), 1970),
        (S.inet_aton(L("10.0.5.9")), 167773449), (S.inet_aton(L("300.1.1.1")), None), (S.inet_ntoa(L(167773449)), "10.0.5.9"),
        (S.password(L("mypass")), "*6C8989366EAF75BB670AD8EA7A7FC1176A95CEF4"), (S.uncompress(S.compress(L("text"))), "text"), (S.uncompressed_length(S.compress(L("text" * 100))), 400),
        (S.uncompress(L(b"junk!!")), None), (S.aes_decrypt(S.aes_encrypt(L("secret"), "k"), "k"), "secret"),
        (S.extract_value(L("<a><b>1</b><b>2</b></a>"), "/a/b"), "1 2"), (S.update_xml(L("<a><b>1</b>t</a>"), "/a/b", "<c/>"), "<a><c/>t</a>"),
        (S.update_xml(L("<a><b/><b/></a>"), "/a/b", "x"), "<a><b/><b/></a>"),
        (S.x_of(S.geometry(L("POINT(1 2)"))), 1.0), (S.x_of(S.geometry(L("LINESTRING(1 2,3 4)"))), None),
        (S.mbr_contains(S.geometry(L("POLYGON((0 0,0 3,3 3,3 0,0 0))")), S.geometry(L("POINT(1 1)"))), 1),
    ]


def test_scalar(spark):
    wrong = []
    for i, (column, want) in enumerate(cases()):
        got = spark.range(1).select(column.alias("v")).first()[0]
        if not (math.isclose(got, want) if isinstance(want, float) and got is not None else got == want):
            wrong.append((i, got, want))
    assert not wrong


def test_week_modes(spark):
    got = spark.range(1).select(*[S.week(D("2008-01-20"), m).alias(str(m)) for m in range(8)]).first()
    assert list(got) == [3, 3, 3, 3, 4, 2, 4, 2]
    assert list(spark.range(1).select(S.week(D("2008-12-31"), 1), S.week(D("2008-12-31"), 3), S.week(D("2000-01-01"), 2), S.week(D("2000-01-01"), 0)).first()) == [53, 1, 52, 0]


def test_aggregates(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "c")], "g int, v string")
    got = {r.g: (r.j, r.n) for r in rows.groupBy("g").agg(A.group_concat(F.col("v")).alias("j"), A.count_distinct(F.col("v"), F.col("g")).alias("n")).collect()}
    assert got == {1: ("a,b", 2), 2: ("c", 1)}
    assert rows.agg(A.group_concat(F.lit("Record_1"), max_len=10)).first()[0] == "Record_1,R"
    none = rows.where("g > 9").agg(A.bit_and(F.col("g")).cast("string"), A.bit_or(F.col("g")).cast("string"), A.group_concat(F.col("v"))).first()
    assert list(none) == ["18446744073709551615", "0", None]
    assert str(spark.createDataFrame([(1,), (2,)], "a int").agg(A.avg_exact(F.col("a"))).first()[0]) == "1.5000"


def test_group_concat_of_large_groups(spark):
    rows = spark.createDataFrame([(1, i, f"v{i % 7}") for i in range(500)] + [(2, 0, None), (None, 1, "x"), (None, 0, "y"), (3, 0, "")], "g int, k int, v string")
    for sep, most, order in [(",", 1024, [F.col("k")]), (",", 10, [F.col("k")]), ("", 20, [F.col("k")]), ("--", 33, None)]:
        want = {r.g: r.j for r in rows.groupBy("g").agg(A.group_concat(F.col("v"), order, sep, most).alias("j")).collect()}
        assert {r.g: r.joined for r in A.group_concat_rows(rows, ["g"], F.col("v"), order, sep, most).collect()} == want
    assert {r.g: r.joined for r in A.group_concat_rows(rows, ["g"], F.col("v"), distinct=True).collect()} == {1: "v0,v1,v2,v3,v4,v5,v6", 2: None, None: "x,y", 3: ""}
    assert A.group_concat_rows(rows.limit(0), ["g"], F.col("v")).count() == 0
    mixed = spark.createDataFrame([(1, i, "" if i % 2 else "a") for i in range(40)], "g int, k int, v string")
    assert A.group_concat_rows(mixed, ["g"], F.col("v"), [F.col("k")], "", 30).first().joined == "a" * 20
    assert A.group_concat_rows(mixed, ["g"], F.col("v"), [F.col("k")], ",", 9).first().joined == "a,,a,,a,,"
