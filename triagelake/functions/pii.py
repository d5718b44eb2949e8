"""Personal data in message text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake import rules


def luhn_valid(number: Column) -> Column:
    """Mod-10 check over the digits of ``number``; 13 to 19 digits, else false."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    size = F.length(digits)
    # From the right, every second digit counts double; both digits of a
    # two-digit double are added, which is 2d - 9.
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            d.try_cast("int") * 2 - F.when(d >= F.lit("5"), 9).otherwise(0)
        ),
    )
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    return size.between(rules.CARD_MIN_DIGITS, rules.CARD_MAX_DIGITS) & (total % 10 == 0)


def card_candidates(text: Column) -> Column:
    """Digit runs that could be card numbers, separators removed."""
    found = F.regexp_extract_all(text, F.lit(rules.CARD_PATTERN), F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, "[ -]", ""))


def is_card(candidate: Column) -> Column:
    size = F.length(candidate)
    return size.between(rules.CARD_MIN_DIGITS, rules.CARD_MAX_DIGITS) & (
        size.isin(*rules.CARD_LENGTHS_ALWAYS) | luhn_valid(candidate)
    )


def has_card(text: Column) -> Column:
    return F.exists(card_candidates(text), is_card)


def has_ssn(text: Column) -> Column:
    return text.rlike(rules.SSN_PATTERN)


def has_password(text: Column) -> Column:
    return text.rlike(rules.PASSWORD_PATTERN)


def has_email(text: Column) -> Column:
    return text.rlike(rules.EMAIL_PATTERN)


def has_phone(text: Column) -> Column:
    """A phone-like match, and at least 10 digits in the whole text."""
    return text.rlike(rules.PHONE_PATTERN) & (
        F.length(F.regexp_replace(text, "[^0-9]", "")) >= rules.PHONE_MIN_DIGITS
    )


def pii_kinds(text: Column, hints: Column | None = None) -> Column:
    """The kinds found, in the fixed order of ``rules.PII_KINDS``.

    ``hints`` is a struct with a boolean per kind; where it is false the kind
    cannot occur and its pattern is not tried.
    """
    checks = (has_card, has_ssn, has_password, has_email, has_phone)
    found = []
    for kind, check in zip(rules.PII_KINDS, checks):
        test = check(text) if hints is None else hints.getField(kind) & check(text)
        found.append(F.when(test, kind))
    return F.array_compact(F.array(*found))
