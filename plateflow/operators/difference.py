"""Colour differences over pixels, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import chroma, hue


def ciede2000(pixels: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str = "de") -> DataFrame:
    """pixels with the difference of color.ciede2000() between two Lab colours (names of columns).

    Each step is a projection whose results later ones name, so no angle or mean is written out again where it is used.
    """
    kept = pixels.columns
    (l1, a1, b1), (l2, a2, b2) = (tuple(F.col(c) for c in x) for x in (one, two))
    col, num = F.col, F.lit
    seventh = lambda c: F.pow(col(c), num(7.0))
    p = pixels.select("*", ((chroma(a1, b1) + chroma(a2, b2)) / num(2.0)).alias("__mean"))
    p = p.select("*", seventh("__mean").alias("__m7"))
    p = p.select("*", (num(0.5) * (num(1.0) - F.sqrt(col("__m7") / (col("__m7") + num(25.0**7))))).alias("__g"))
    p = p.select(*kept, (a1 * (num(1.0) + col("__g"))).alias("__p1"), (a2 * (num(1.0) + col("__g"))).alias("__p2"))
    angle = lambda a, b: F.when((a == 0) & (b == 0), num(0.0)).otherwise(hue(a, b))
    p = p.select(*kept, *[c.alias(n) for c, n in ((chroma(col("__p1"), b1), "__c1"), (chroma(col("__p2"), b2), "__c2"), (angle(col("__p1"), b1), "__h1"), (angle(col("__p2"), b2), "__h2"))])
    p = p.select("*", (col("__c1") * col("__c2")).alias("__cc"), (col("__h2") - col("__h1")).alias("__turn"), (col("__h1") + col("__h2")).alias("__total"), ((l1 + l2) / num(2.0)).alias("__ml"), ((col("__c1") + col("__c2")) / num(2.0)).alias("__mc"))
    gray, turn, total = col("__cc") == 0, col("__turn"), col("__total")
    dh = F.when(gray, num(0.0)).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - num(360.0)).otherwise(turn + num(360.0))
    mh = F.when(gray, total).when(F.abs(turn) <= 180, total / num(2.0)).when(total < 360, (total + num(360.0)) / num(2.0)).otherwise((total - num(360.0)) / num(2.0))
    p = p.select("*", dh.alias("__dh"), mh.alias("__mh"), seventh("__mc").alias("__c7"), ((col("__ml") - num(50.0)) * (col("__ml") - num(50.0))).alias("__off"))
    mh, cos = col("__mh"), (lambda d: F.cos(F.radians(d)))
    t = num(1.0) - num(0.17) * cos(mh - num(30.0)) + num(0.24) * cos(num(2.0) * mh) + num(0.32) * cos(num(3.0) * mh + num(6.0)) - num(0.2) * cos(num(4.0) * mh - num(63.0))
    p = p.select("*", t.alias("__t"), ((mh - num(275.0)) / num(25.0)).alias("__bend"))
    rotation = num(-1.0) * F.sin(F.radians(num(60.0) * F.exp(num(-1.0) * col("__bend") * col("__bend")))) * num(2.0) * F.sqrt(col("__c7") / (col("__c7") + num(25.0**7)))
    x = (l2 - l1) / (num(1.0) + num(0.015) * col("__off") / F.sqrt(num(20.0) + col("__off")))
    y = (col("__c2") - col("__c1")) / (num(1.0) + num(0.045) * col("__mc"))
    z = num(2.0) * F.sqrt(col("__cc")) * F.sin(F.radians(col("__dh") / num(2.0))) / (num(1.0) + num(0.015) * col("__mc") * col("__t"))
    p = p.select(*kept, x.alias("__x"), y.alias("__y"), z.alias("__z"), rotation.alias("__r"))
    x, y, z = col("__x"), col("__y"), col("__z")
    return p.select(*kept, F.sqrt(F.greatest(num(0.0), x * x + y * y + z * z + col("__r") * y * z)).alias(name))
