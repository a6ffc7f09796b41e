import unicodedata

from pyspark.sql import functions as F

from sourceloom.functions import numbers, periods, words
from sourceloom.functions.fold import ascii_fold, node_slug, slug, strip_accents


def test_folding_agrees_with_the_unicode_database(column):
    texts = ["Société Générale", "ﬁnance ½ №5", "plain", "𝐀bc Ω", "Ⅷ ① ⑩ x²", "ñandú ß ŀ ŉ", "Łódź", "ｆｕｌｌ　width", ""]
    assert column(ascii_fold, texts) == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert column(strip_accents, texts) == [
        "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]


def test_slugs(column):
    assert column(slug, ["Globex -- Industries, S.A.", "¡!"]) == ["globex-industries-s-a", ""]
    assert column(node_slug, ["¡!", "a" * 80]) == ["x", "a" * 60]


def test_figures_and_values(column):
    shown = column(numbers.figure_tokens, ["1,200,000.50 and 42k, 3.14% v2 1.2.3 12.50x 12 months", "é12 2.5bn"])
    assert [[t.strip() for t in s] for s in shown] == [["1,200,000.50", "42k", "3.14%", "1.2", "12", "12"], ["2.5bn"]]
    keys = dict(zip(["1.200", "1200", "1.2", "42k", "42000", "1,5", "1.5", "1.200.000", "1.2M"],
                    map(set, column(numbers.token_keys, ["1.200", "1200", "1.2", "42k", "42000", "1,5", "1.5", "1.200.000", "1.2M"]))))
    assert keys["1.200"] == keys["1200"] | keys["1.2"]
    assert keys["42000"] < keys["42k"] and keys["1,5"] == keys["1.5"] and keys["1.200.000"] < keys["1.2M"]
    assert column(numbers.spaced_group_keys, ["x 1 200 000 y"])[0] == column(numbers.token_keys, ["1200000"])[0]


def test_six_digit_key_rounds_half_to_even_like_printf(column):
    values = ["1234565", "1234575", "999999.5", "0.1234567", "100000", "0", "7.5e9"]
    keys = column(lambda c: numbers.six_digit_key(c.cast("double")), values)
    texts = [f"{float(v):.5e}" for v in values]
    for i in range(len(values)):
        for j in range(len(values)):
            assert (keys[i] == keys[j]) == (texts[i] == texts[j])


def test_parse_num(column):
    cases = {"1.200": 1.2, "1,200": 1200.0, "1,5": 1.5, "1.200.000": 1200000.0, "$1.2M": 1200000.0, "12 USD": 12.0,
             "€ 5bn": 5e9, "-3": -3.0, "12d": None, "nan": None, "": None, "1 200": 1200.0, "1.234,56": 1234.56, "50%": 50.0}
    assert column(numbers.parse_num, list(cases)) == list(cases.values())


def test_periods(column):
    cases = {"2026-03-05": "2026-03", "Q1 2026-03-05": "2026-03", "2026 Q2": "2026-Q2", "Q3 of 2024": "2024-Q3",
             "in March\n2026 we": "2026-03", "may 2026": "2026", "2026-03 and 2026-04": None, "Q2": None,
             "x2026": None, "2026/1/15": "2026-01", "Sept, 2025": "2025-09", "2026-13": "2026"}
    assert column(periods.parse_period, list(cases)) == list(cases.values())


def test_provable_as_of(spark):
    rows = [("2026-03-05", "on 2026-03-05.", "2026-03-05"), ("2026-03-05", "March 2026", "2026-03"),
            ("2026-03-05", "Q1 2026", "2026-Q1"), ("2026-03", "in 2026", "2026"), ("2026-03", "none", None), ("1999-01", "1999", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "d string, h string").coalesce(1)
    assert [r[0] for r in df.select(periods.provable_as_of(F.col("d"), F.col("h"))).collect()] == [r[2] for r in rows]


def test_names(column):
    assert column(words.entity_key, ["Globex, S.A.", "ACME Inc. Ltd", "Co", "Globex-Industries"]) == [
        "globex", "acme", "co", "globex-industries"]
    assert column(words.version_stem, ["a/Report v2 FINAL (1).docx"]) == ["report"]
    assert column(words.marker_score, ["x FINAL.md", "x draft v3.md", "x copy.md", "x.md"]) == [100, -97, -1, 0]


def test_cells_compare_by_compatibility(column):
    from sourceloom.functions.fold import cell_norm
    pairs = [("ﬁnal", "final"), ("½ cup", "1⁄2 cup"), ("Café", "café"), ("ＡＢＣ", "abc"),
             ("ế", "ế"), ("㎏", "kg"), ("plain", "plain")]
    got = column(cell_norm, [x for pair in pairs for x in pair])
    assert got[::2] == got[1::2]


def test_private_use_characters_do_not_read_as_periods(spark):
    from sourceloom.operators.verification import verify_pages
    rows = [(i, "ARR was 512000 in 2026-03.", f"ARR 512000 in 2026-01{sign}.", "") for i, sign in enumerate(["", "", "", ""])]
    out = verify_pages(spark.createDataFrame(rows, "k int, body string, source string, context string"), ["k"]).collect()
    assert [r.numbers_unanchored for r in out] == [["512000"]] * 4


def test_all_failing_figures_are_listed(spark):
    from sourceloom.operators.verification import verify_pages
    body = " ".join(f"{1000 + 37 * i}" for i in range(40))
    r = verify_pages(spark.createDataFrame([(1, body, "none", "")], "k int, body string, source string, context string"), ["k"]).first()
    assert len(r.numbers_unverified) == 40 == r.n_unverified
