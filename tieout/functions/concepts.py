"""What column labels mean: fixed lists of names, and how labels are held against them."""

from __future__ import annotations

import re

#: The names of each concept in reviews.
CONCEPTS = {
    "entity_id": ("entity id", "legal entity id", "legal entity identifier", "entity code", "le id"),
    "entity_name": ("entity", "entity name", "legal entity", "legal entity name", "fund entity", "le", "le name"),
    "investor_id": ("investor id", "investor identifier", "investor code", "lp id"),
    "investor_name": ("investor", "investor name", "limited partner", "lp name"),
    "deal_id": ("deal id", "deal code", "deal identifier", "investment id"),
    "deal_name": ("deal", "deal name", "investment name"),
    "account_id": ("account code", "gl code", "gl account", "gl account code", "account number", "account id"),
    "account_name": ("account name", "gl account name", "account description"),
    "currency": ("currency", "currency code", "ccy", "transaction currency", "entity currency", "base currency"),
    "amount": ("amount", "transaction amount", "entity amount", "base amount", "balance", "net amount", "value"),
    "date": ("date", "transaction date", "effective date", "posting date", "period", "reporting period"),
    "reference": ("reference", "transaction id", "journal id", "batch id", "batch", "journal number"),
    "status": ("status", "review status", "review", "mapping status"),
}
#: Words of a title that make a bare name or id one of its domain.
DOMAINS = {"entity": ("entity", "entities"), "investor": ("investor", "investors"), "deal": ("deal", "deals"), "account": ("account", "accounts")}
BARE = {"name": "name", "id": "id", "identifier": "id", "code": "id"}
#: Words of a title that make a table a list to refer to.
LISTS = ("mapping", "mappings", "list", "listing", "reference", "master")
#: The names of each role of a transaction's columns.
ROLES = {
    "reference": ("reference", "transaction reference", "transaction id", "reference number", "bank reference"),
    "account": ("account", "account number", "bank account", "bank account number", "iban"),
    "currency": ("currency", "ccy", "currency code", "transaction currency"),
    "date": ("date", "transaction date", "booking date", "value date", "effective date"),
    "amount": ("amount", "transaction amount", "net amount", "amount local"),
    "debit": ("debit", "debit amount", "withdrawal", "withdrawals", "money out"),
    "credit": ("credit", "credit amount", "deposit", "deposits", "money in"),
    "batch": ("batch", "batch id", "journal batch", "journal number"),
}
#: First cells of rows that explain the row before.
NARRATIVE = ("narrative", "description", "transaction details")
#: Headers of supporting tables, and first cells of key and value pages.
REFERENCE_HEADERS = ("legal entity", "vendor", "account number", "bank account", "account", "project code", "related party", "deal name", "investor", "security id", "stage", "allocation rules")
PAIRS = ("account name", "account number", "currency", "account currency", "iban", "bank", "statement date", "statement period", "opening balance", "closing balance", "from", "to", "bank name", "location", "bic", "account status", "account type")

CONCEPT_OF: dict[str, set[str]] = {}
for _concept, _names in CONCEPTS.items():
    for _name in _names:
        CONCEPT_OF.setdefault(_name, set()).add(_concept)
ROLE_OF = {name: role for role, names in ROLES.items() for name in names}


def words(label: str | None) -> str:
    """A label in lower-case words; camelCase is parted."""
    return " ".join(re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", label or "").lower()))


def concept(label: str | None, title: str = "") -> str | None:
    """The one concept that a label names: as a whole, by its longest ending of several words, or with the title's domain."""
    name = words(label)
    parts = name.split()
    for start in range(len(parts) - 1):
        if len(found := CONCEPT_OF.get(" ".join(parts[start:]), ())) == 1:
            return next(iter(found))
    if name in CONCEPT_OF:
        return next(iter(CONCEPT_OF[name]))
    of_title = set(words(title).split())
    domains = [d for d, names in DOMAINS.items() if of_title.intersection(names)]
    return f"{domains[0]}_{BARE[name]}" if name in BARE and len(domains) == 1 else None


def header_score(labels: list[str | None]) -> int:
    """How many labels name a concept; 0 where half of them or more are numbers."""
    some = [x.strip() for x in labels if x and x.strip()]
    numbers = [x for x in some if re.fullmatch(r"[+-]?[\d,.]+", x)]
    return sum(concept(x) is not None for x in some) if some and 2 * len(numbers) < len(some) else 0


def roles(labels: dict[str, str | None]) -> dict[str, str]:
    """role -> key for roles that one label names."""
    found: dict[str, list[str]] = {}
    for key, label in labels.items():
        if role := ROLE_OF.get(" ".join(re.findall("[a-z0-9]+", (label or "").lower()))):
            found.setdefault(role, []).append(key)
    return {role: keys[0] for role, keys in found.items() if len(keys) == 1}
