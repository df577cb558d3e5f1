import pytest

from sparkdossier.functions import scanners
from sparkdossier.operators import spans

# Answer, source, and whether the source supports it.
CASES = [
    ("1234,56", "SUM 1 234,56 kr", True), ("1234.56", "SUM 1 234,56 kr", True), ("1234,56", "SUM 1.234,56 kr", True), ("1 234,56", "Belop kr 1234,56", True), ("41288903", "Telefon 41 28 89 03", True),
    ("12.06.2026", "Dato 12/06/2026", True), ("12. juni 2026", "Dato 2026-06-12", True), ("1234567,00", "Belop 1 234 567,00", True), ("296,71", "SUM 268,00 og mva 28,71", False), ("1234,57", "Belop 1234,56", False),
    ("2026-06-24", "Dato 12.06.2026", False), ("26800", "Sum 268,00 kroner", False), ("26 800", "Sum 268,00 kroner", False), ("268,00", "Sum 26800 kroner", False), ("12345", "Belop 123.45 USD", False),
    ("1234567", "Belop 12345,67 kr", False), ("23", "Belop 23,00 kroner", True), ("23,00", "Belop 23 kroner", True), ("23,50", "Belop 23 kroner", False), ("1 234,56", "Sum 1\u202f234,56 kroner", True),
    ("1234.56.78903", "Konto 12345678903", True), ("12345678903", "Konto 1234.56.78903", True), ("010170 12345", "fnr 01017012345", True), ("2026", "den 12.06.2026", True), ("268 og 1234", "rad 268 1234 5", True),
    ("268 1234", "først 268, så 1234", True), ("268 1235", "først 268, så 1234", False), ("7", "ingen tall", True), ("500", None, False), (None, "500", True), ("", "", True), ("500", "", False),
]


def test_numbers_of_answers(spark):
    a = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(CASES)], "id int, svar string")
    k = spark.createDataFrame([(i, k) for i, (_, k, _) in enumerate(CASES)], "id int, kilde string")
    missing = {r.id: r.tall for r in spans.unsupported_numbers(a, k).collect()}
    assert missing == {i: s for i, (s, _, ok) in enumerate(CASES) if not ok}
    assert spans.unsupported_numbers(a.limit(0), k).count() == 0 and spans.unsupported_numbers(a.union(a), k.union(k)).count() == len(missing)
    assert {r.id for r in spans.unsupported_numbers(a, k.limit(0)).collect()} >= set(missing)


def test_a_date_is_not_torn_up():
    assert [x["tall"] for x in scanners.stated_numbers("Frist 12.03.2024, 1.200 kr, 3. mai 2024")] == ["2024-03-12", "1200", "2024-05-03"]


@pytest.mark.parametrize("raw, want", [("1.234", ["1", "234"]), ("1234.5", ["1234,5"]), ("1.234.56", ["1", "234", "56"]), ("1 234.50", ["1", "234,5"]), ("7,00", ["7"]), ("5", ["5"])])
def test_blocks_of_numbers(raw, want):
    assert scanners.number_parts(raw) == want
