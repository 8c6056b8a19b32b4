"""The audit of supplementary dictionaries looks every name up once."""

import contextlib
import io

from bibliomill.functions.variants import Variants
from bibliomill.operators import aliases as A


def test_names_are_spelled_and_looked_up_once_for_all_rules(spark):
    lines = [
        ("main", 0, 1, "cafe,cafes,bar"), ("main", 0, 2, "inn,tavern"),
        ("more", 1, 1, "café,cafés,new,é"), ("more", 1, 2, "inn,tavern,tavern"), ("more", 1, 3, "pub,bar"), ("more", 1, 4, "café,cafe"),
    ]
    alias = A.parse_alias_lines(spark.createDataFrame(lines, "source string, source_rank int, line_no long, line string"))
    variants = Variants({"t2s": [("é", "e")]})
    out = A.audit(alias.filter("source_rank > 0"), alias.filter("source_rank = 0"), variants)
    assert sorted(tuple(r) for r in out.collect()) == sorted([
        ("repeated_canon", "more", "café", ""), ("one_char", "more", "café", "é"), ("repeated_in_group", "more", "inn", "tavern"),
        ("addition", "more", "café", "new"), ("addition", "more", "café", "é"), ("addition", "more", "café", "cafe"),
        ("redundant", "more", "inn", "inn"), ("other_owner", "more", "pub", "bar"),
        ("spelling_only", "more", "café", "cafe"),
    ])
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert "Generate" not in plan.getvalue()


def test_spellings_of_a_word_name_each_round_once(spark):
    steps = Variants({"t2s": [("é", "e")], "s2t": [("e", "é"), ("c", "ç")], "s2tw": [("e", "è")]})
    row = spark.createDataFrame([("cafe",), ("",), (None,)], "w string")
    got = {r.w: r.v for r in row.select("w", steps.variants(row["w"]).alias("v")).collect()}
    assert got["cafe"][:2] == ["çafé", "cafè"] and got[""] == [] and got[None] in (None, [])
    assert str(steps.variants(row["w"])).count("translate(") <= 9
