import random

import pytest
from pyspark.sql import functions as F

from kpiloom.functions.fingerprint import farm_fingerprint
from kpiloom.functions.hashing import bucket
from kpiloom.operators.assignment import ab_group

K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
MOD = 1 << 64

# published examples of the warehouse function, and of the hash of a short word
PUBLISHED = {"1footrue": -1541654101129638711, "2applefalse": 2794438866806483259, "3true": -4880158226897771312,
             "test": 8581389452482819506}


def plain(text: str) -> int:
    """The hash in whole numbers, for texts of up to 32 bytes."""
    s = text.encode()
    n = len(s)
    word = lambda i, size=8: int.from_bytes(s[i:i + size], "little")
    turn = lambda v, k: (v >> k | v << (64 - k)) % MOD
    fold = lambda v: v ^ (v >> 47)
    mul = (K2 + 2 * n) % MOD

    def mix(u, v):
        return fold((v ^ fold((u ^ v) * mul % MOD)) * mul % MOD) * mul % MOD

    if n > 16:
        a, b, c, d = word(0) * K1 % MOD, word(8), word(n - 8) * mul % MOD, word(n - 16) * K2 % MOD
        r = mix((turn((a + b) % MOD, 43) + turn(c, 30) + d) % MOD, (a + turn((b + K2) % MOD, 18) + c) % MOD)
    elif n >= 8:
        a, b = (word(0) + K2) % MOD, word(n - 8)
        r = mix((turn(b, 37) * mul + a) % MOD, (turn(a, 25) + b) * mul % MOD)
    elif n >= 4:
        r = mix((n + (word(0, 4) << 3)) % MOD, word(n - 4, 4))
    elif n:
        r = fold((s[0] + (s[n // 2] << 8)) * K2 % MOD ^ (n + (s[-1] << 2)) * K0 % MOD) * K2 % MOD
    else:
        r = K2
    return r - MOD if r >= MOD // 2 else r


def test_published_values(spark):
    assert {t: plain(t) for t in PUBLISHED} == PUBLISHED
    df = spark.createDataFrame([(t,) for t in PUBLISHED], "t string")
    assert {r.t: r.f for r in df.select("t", farm_fingerprint(F.col("t")).alias("f")).collect()} == PUBLISHED


def test_equals_whole_numbers_at_every_length(spark):
    rng = random.Random(1)
    texts = [""] + [str(rng.randrange(10 ** (n - 1), 10 ** n)) for n in range(1, 20) for _ in range(8)]
    texts += [str(-rng.randrange(1 << 63)) for _ in range(40)] + ["-9223372036854775808", "0", "é", "naïve Σ", "x" * 32]
    texts += ["".join(rng.choice("abcxyz019-é") for _ in range(n))[:n] for n in range(1, 26) for _ in range(4)]
    texts = [t for t in texts if len(t.encode()) <= 32]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(4)
    got = df.select("t", farm_fingerprint(F.col("t")).alias("f")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.f == (None if r.t is None else plain(r.t)), r.t


def test_long_texts_raise(spark):
    df = spark.createDataFrame([("x" * 33,)], "t string")
    with pytest.raises(Exception, match="up to 32 bytes"):
        df.select(farm_fingerprint(F.col("t"))).collect()


def test_buckets_take_the_absolute_value_first(spark):
    ids = spark.range(1, 3000).withColumnRenamed("id", "k")
    for r in ids.select("k", bucket("k", 100, "farm").alias("b")).collect():
        assert r.b == abs(plain(str(r.k))) % 100
    users = spark.range(1, 3000).select("id", F.current_timestamp().alias("created_at"))
    share = ab_group(users, method="farm").where("ab_group = 'A'").count() / 2999
    assert 0.46 < share < 0.54
