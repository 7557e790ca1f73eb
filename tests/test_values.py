"""Byte decoders against struct, text comparison against plain loops."""

import random
import struct
import uuid

from pyspark.sql import functions as F

from lodeframe.functions import bytes as b, texts


def test_numbers_in_bytes(spark):
    rnd = random.Random(3)
    rows = [rnd.randbytes(16) for _ in range(200)] + [struct.pack("<dd", x, y) for x, y in ((0.0, -0.0), (5e-324, 1.7e308), (float("inf"), -1.5), (2.2e-308, 1.0))]
    rows += [struct.pack("<4f", 1e-45, 1.5, float("-inf"), 3.4e38), b"\xff" * 16, b"\x80" + bytes(15)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, d binary")
    d = F.col("d")
    kinds = {"b": (1, b.signed), "h": (2, b.signed), "H": (2, b.unsigned), "i": (4, b.signed), "I": (4, b.unsigned), "q": (8, b.signed)}
    cells = {(k, at, little): f(d, at, n, little) for k, (n, f) in kinds.items() for at in (0, 5) for little in (False, True)}
    cells |= {("f", at, little): b.float32(d, at, little) for at in (0, 4) for little in (False, True)}
    cells |= {("d", at, little): b.float64(d, at, little) for at in (0, 8) for little in (False, True)}
    got = df.select("i", *(c.alias(f"c{j}") for j, c in enumerate(cells.values()))).collect()
    for r in got:
        for j, (k, at, little) in enumerate(cells):
            want = struct.unpack_from(("<" if little else ">") + k, rows[r.i], at)[0]
            assert r[f"c{j}"] == want or (r[f"c{j}"] != r[f"c{j}"] and want != want), (k, at, little, rows[r.i])


def test_other_values_and_ends(spark):
    rows = [bytes(range(60, 76)), b"a\x00\xff", b"", None]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(rows)], "i int, d binary")
    d = F.col("d")
    got = df.select("i", b.ascii_char(d, 0).alias("a"), b.ascii_char(d, 1).alias("a1"), b.bits(d, 0).alias("bits"), b.rgba(d, 0).alias("rgba"), b.guid(d, 0).alias("guid"),
                    F.unix_seconds(b.unix_time(d, 0)).alias("t"), b.float32(d, 0).alias("f"), b.signed(d, 0, 8).alias("q"), b.unsigned(d, 2, 1).alias("last"), b.unsigned(d, -1, 1).alias("before")).orderBy("i").collect()
    assert tuple(got[0])[1:7] == ("'<'", "'='", "00111100", "#3C3D3E3F", str(uuid.UUID(bytes=rows[0])), struct.unpack("<I", rows[0][:4])[0])
    assert tuple(got[1])[1:] == ("'a'", "·", "01100001", None, None, None, None, None, 255, None)
    assert set(tuple(got[2])[1:]) == set(tuple(got[3])[1:]) == {None}


def test_common_parts(spark):
    pairs = [("abc", "abd"), ("", "x"), ("same", "same"), ("a", "ab"), ("ba", "a"), ("xy", "zw"), ("\U0001f600a", "\U0001f601a"), (None, "a"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", texts.common_prefix(F.col("a"), F.col("b")).alias("p"), texts.common_suffix(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [(r.p, r.s) for r in got] == [(2, 0), (0, 0), (4, 4), (1, 0), (0, 1), (0, 0), (1, 1), (None, None), (0, 0)]


def test_distance_of_a_diff(spark):
    diffs = [[("DELETE", "abc"), ("INSERT", "1234"), ("EQUAL", "xyz")], [("EQUAL", "xyz"), ("DELETE", "abc"), ("INSERT", "1234")],
             [("DELETE", "abc"), ("EQUAL", "xyz"), ("INSERT", "1234")], [], None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(diffs)], "i int, d array<struct<operation:string,text:string>>")
    assert [r.n for r in df.select("i", texts.diff_distance(F.col("d")).alias("n")).orderBy("i").collect()] == [4, 4, 7, 0, None]
