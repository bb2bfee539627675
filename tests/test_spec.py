import pytest

from pactlake.functions import patterns
from pactlake.plans.spec import ContractError, Version, parse

GOOD = """
contract: 1
id: orders
version: 1.2.0
owner: team
models:
  orders:
    fields:
      id: {type: string, required: true}
"""


def errors(fields: str, head: str = "version: 1.0.0") -> list[str]:
    c = parse(f"contract: 1\nid: x\n{head}\nmodels:\n  m:\n    fields:\n      f: {fields}\n")
    return [f.message for f in c.lint() if f.level == "error"]


def test_a_plain_contract_is_enforceable():
    c = parse(GOOD)
    assert c.enforceable() and not c.lint()
    assert c.model()[0] == "orders"


@pytest.mark.parametrize("text", ["[]", "contract: 1", GOOD + "extra: 1\n", GOOD.replace("type: string", "type: text"), GOOD.replace("required: true", "requird: true"), GOOD.replace("required: true", "required: 1"), GOOD + "id: again\n"])
def test_unreadable_documents(text):
    with pytest.raises(ContractError):
        parse(text)


@pytest.mark.parametrize(
    "field",
    [
        "{type: integer, pattern: x}", "{type: string, pattern: '('}", "{type: string, pattern: 'a(?=b)'}", "{type: string, pattern: '(a)\\1'}", "{type: date, format: email}",
        "{type: string, min: 1}", "{type: integer, min: 3, max: 2}", "{type: float, min: .inf}", "{type: integer, min_length: 1}", "{type: string, min_length: 3, max_length: 2}",
        "{type: string, allowed: []}", "{type: integer, allowed: [1.5]}", "{type: boolean, allowed: [1]}", "{type: date, allowed: ['2026-02-30']}", "{type: uuid, allowed: [x]}",
        "{type: timestamp, allowed: ['2026-01-01T00:00:00']}",
    ],
)
def test_each_lint_error(field):
    assert errors(field)


def test_lint_of_the_head():
    assert errors("{type: string}", "version: '1.2'")
    assert {f.path for f in parse(GOOD.replace("owner: team\n", "")).lint()} == {"owner"}
    assert [f.level for f in parse(GOOD.replace("required: true", "unique: true, nullable: true")).lint()] == ["warning"]


def test_model_resolution():
    c = parse(GOOD + "  other:\n    fields:\n      id: {type: string}\n")
    with pytest.raises(ContractError):
        c.model()
    with pytest.raises(ContractError):
        c.model("none")
    assert c.model("other")[0] == "other"


def test_dates_stay_text_and_order_is_kept():
    c = parse(GOOD.replace("id: {type: string, required: true}", "z: {type: date, allowed: [2026-01-01]}\n      a: {type: string}"))
    assert list(c.models["orders"].fields) == ["z", "a"] and c.models["orders"].fields["z"].allowed == ("2026-01-01",)


def test_versions_sort_by_precedence():
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1"]
    assert sorted(order, key=lambda v: Version.parse(v).order) == order
    assert Version.parse("01.0.0") is None and Version.parse("1.0") is None


@pytest.mark.parametrize("bad", ["a++", "(?>a)", "(?!a)", r"\1", "a{2,}+", "*a", "(", "[a", r"\q", "[a&&b]", "(?x) a"])
def test_refused_patterns(bad):
    assert patterns.check(bad)


@pytest.mark.parametrize("good", ["^[a-z]{3}$", "a|b", r"\d+\.\d*", "(?P<n>a)", "(?i)x", "[[:alpha:]]+", r"\p{L}", "a{2,3}?", "[^]]", "}"])
def test_accepted_patterns(good):
    assert patterns.check(good) is None
