"""URL filters whose decisions follow redirects.

Rules decide by host and path. Redirects and canonical links join addresses into groups, and an address without a rule of
its own takes its group's decision.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ascii_lower, stored

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """Decides a host with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Lower-case host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for a missing or other address."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What identifies an address: host, path and query, without scheme and fragment. Missing without ``://``."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); an allow rule comes before a block rule of the same length."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    table = F.array(*[
        F.struct(F.lit(r.host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).alias("h"), F.lit(r.path).alias("p"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        for r in ordered
    ])
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["text"].alias("text"), first["verdict"].alias("verdict")))


def absolute(target: Column, base: Column) -> Column:
    """A link target as an absolute address: as it stands, with the page's scheme, or on the page's host."""
    origin = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target != "", F.concat(F.regexp_extract(base, r"^([^:]*://[^?#]*/)", 1), target))
    )


def page_links(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(source, target) of the canonical link and of the refresh redirect of each page."""
    html = F.coalesce(F.col(page), F.lit(""))
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    refresh = F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    href = F.trim(F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.trim(F.regexp_extract(refresh, r"(?i)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1))
    return (
        pages.select(F.col(url).alias("source"), F.explode(F.array(href, to)).alias("target"))
        .where(F.col("source").isNotNull() & (F.col("target") != ""))
        .select("source", absolute(F.replace(F.col("target"), F.lit("&amp;"), F.lit("&")), F.col("source")).alias("target"))
    )


def judge_urls(pages: DataFrame, keep: list[str], rules: list[Rule], links: DataFrame, *, url: str = "url") -> DataFrame:
    """``keep`` columns of every row with ``host``, ``path``, ``rule`` (text of the rule that fits, or missing) and ``verdict``.

    A rule of its own decides an address. Otherwise its group decides: allow if one of the group's addresses is allowed by
    a rule, else block if one is blocked. Addresses outside of any group are allowed. ``links`` has (source, target);
    links to or from a missing address join nothing. Repeated rows stay.
    """
    ends = links.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).where("a <> b")
    groups = stored(components(ends), "aliases")
    at = F.concat(F.lit("x://"), F.col("node"))
    ruled = groups.withColumn("_r", matched_rule(host_of(at), path_of(at), rules))
    verdicts = ruled.groupBy("component").agg(
        F.max(F.col("_r")["verdict"] == "allow").alias("allowed"), F.max(F.col("_r")["verdict"] == "block").alias("blocked"),
    )
    aliases = stored(
        groups.join(verdicts.where("blocked and not coalesce(allowed, false)").select("component"), "component").select("node"), "blocked_aliases",
    )
    judged = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address(F.col(url)).alias("_at"))
    judged = judged.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    joined = judged.join(aliases.withColumn("_blocked", F.lit(True)), F.col("_at") == F.col("node"), "left")
    verdict = F.coalesce(F.col("_rule")["verdict"], F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return joined.select(*keep, "host", "path", F.col("_rule")["text"].alias("rule"), verdict.alias("verdict"))
