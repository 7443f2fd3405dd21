"""Rule conditions on the decoded url, and the first-match verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import contains_ignore_case, java_pattern


def names_login(url: Column) -> Column:
    """Whether the decoded url mentions a login; false for NULL."""
    named = contains_ignore_case(url, "login") | contains_ignore_case(url, "auth")
    return F.coalesce(named, F.lit(False))


def is_failed_login(url: Column, status: Column) -> Column:
    return F.coalesce(status.isin(*V.REFUSED_STATUS), F.lit(False)) & names_login(url)


def signature_name(url: Column) -> Column:
    """First attack signature found in the decoded url, else NULL."""
    name = F.when(F.lit(False), "")
    for attack, pattern in V.ATTACK_SIGNATURES:
        name = name.when(url.rlike(java_pattern(pattern, ignore_case=True)), attack)
    return name


def is_sensitive_path(url: Column) -> Column:
    return url.rlike(java_pattern("(?:" + "|".join(V.SENSITIVE_PATHS) + ")", ignore_case=True))


def is_privileged_access(url: Column, status: Column) -> Column:
    found = F.lit(False)
    for part in V.PRIVILEGED_PARTS:
        found = found | F.contains(url, F.lit(part))
    return found & (status == 200)


def rule_number(
    url: Column,
    status: Column,
    signature: Column,
    sensitive: Column,
    requests: Column,
    failed_logins: Column,
) -> Column:
    """Position in ``RULES`` of the first rule that fires."""
    order = [rule[0] for rule in V.RULES]
    conditions = {
        "flood": requests > V.FLOOD_MORE_THAN,
        "brute force": failed_logins >= V.FAILED_LOGIN_AT_LEAST,
        "signature": signature.isNotNull(),
        "open path": sensitive & (status == 200),
        "closed path": sensitive,
        "privilege": is_privileged_access(url, status),
        "not found": status == 404,
        "server error": status == 500,
    }
    number = F.when(F.lit(False), 0)
    for name, condition in conditions.items():
        number = number.when(condition, order.index(name))
    return number.otherwise(order.index("normal"))


def rule_verdict(
    number: Column,
    url: Column,
    status: Column,
    signature: Column,
    requests: Column,
    failed_logins: Column,
) -> Column:
    """The verdict of the rule at ``number``: looked up, not one branch per rule and field."""

    def looked_up(field: int) -> Column:
        return F.get(F.array(*[F.lit(rule[field]) for rule in V.RULES]), number)

    subject = F.get(F.array(*[F.lit(rule[7]) for rule in V.RULES]), number)
    scanned = F.concat(url, F.lit("' resulting in HTTP "), status.cast("string"))
    text = (
        F.when(subject == "requests", requests.cast("string"))
        .when(subject == "failures", failed_logins.cast("string"))
        .when(subject == "url", url)
        .when(subject == "scan", scanned)
        .otherwise("")
    )
    return F.struct(
        looked_up(1).alias("is_threat"),
        F.coalesce(looked_up(2), signature).alias("threat_type"),
        looked_up(3).alias("severity"),
        looked_up(4).alias("score"),
        F.concat(looked_up(5), text, looked_up(6)).alias("details"),
    )
