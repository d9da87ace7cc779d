"""URL filters with redirect equivalence.

A rule names a host and the beginning of a path; it fits the host and all its subdomains,
and the longest fitting rule decides. Rules are looked up by the suffixes of the host, not tried
one after the other.

Pages without a rule of their own take the verdict of their aliases. Aliases are found from
what pages say about themselves: ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``
are edges between URLs, and all URLs connected by such edges are one thing. In a component an
explicit allow of any member goes before a block of another one; with neither, the verdict is
``DEFAULT``. A page's own rule always goes first. URLs that are only pointed to count as members.

URLs are nodes by host and path with query, without scheme and fragment; an empty path is ``/``, and dot segments are
resolved. Targets are resolved against the page as RFC 3986 has it, ``&amp;`` in them decoded; those of other kinds (``mailto:``) are none. Null URLs, and those without ``://``, have an empty host and path,
fit no rule and join no component. Rows that repeat are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import let
from contactloom.llm.components import components
from contactloom.session import stage

ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: the same for every scheme and fragment, for ``h`` and ``h/``, and for ``/a/./b/../c``
    and ``/a/c``. Null without a host."""
    query = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), _without_dots(path_of(url)), query))


def _without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved; ``/`` if it is empty."""
    segments = F.slice(F.split(path, "/", -1), 2, F.length(path) + 1)
    none = F.array().cast("array<string>")
    left = F.aggregate(segments, none, lambda done, s: (
        F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    ))
    ends = F.when(F.rlike(path, F.lit(r"/\.\.?\z")), F.array(F.lit(""))).otherwise(none)
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(left, ends), "/"))
    return F.when(path == "", F.lit("/")).when(F.rlike(path, F.lit(r"/\.\.?(/|\z)")), resolved).otherwise(path)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Ties: the later in code-point order."""
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    table = F.create_map(
        *[
            part
            for name, own in by_host.items()
            for part in (
                F.lit(name),
                F.array(*[F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in own]),
            )
        ]
    )
    labels = F.split(host, r"\.")
    suffixes = let(
        labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), "."))
    )
    near = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(table, s)), lambda s: F.element_at(table, s)))
    return F.array_max(F.filter(near, lambda r: F.startswith(path, r.path)))


def _target(base: Column, href: Column) -> Column:
    """The URL a page points to, resolved against its own; node_of resolves its dot segments."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    own = F.concat(root, path_of(base))
    folder = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.rlike(href, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.lit(None))
        .when(F.startswith(href, F.lit("?")), F.concat(own, href))
        .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), F.lit("")).otherwise(F.lit("/")), href))
    )


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that pages declare to be the same."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tagged = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(
        F.col("html").isNotNull() & F.rlike("html", F.lit(r"(?i)canonical|refresh"))
    )
    each = tagged.select("url", F.explode(tags).alias("tag"))
    rel = F.rlike("tag", F.lit(r"(?is)\A<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    refresh = F.rlike("tag", F.lit(r"(?is)\A<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]*)", 1)
    goal = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?\s*([^\"'\s>]*)", 1)
    said = F.regexp_replace(F.when(rel, href).when(refresh, goal), "(?i)&(?:amp|#38|#x26);", "&")
    found = each.select("url", said.alias("href")).where("href IS NOT NULL AND href != ''")
    return (
        found.select(node_of(F.col("url")).alias("a"), node_of(_target(F.col("url"), F.col("href"))).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .distinct()
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", default: str = DEFAULT
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component), a row for each of ``pages``.

    ``component`` is the smallest node of the aliases, null for pages without any.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")
    )
    judged = judged.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    roots = stage(components(stage(edges(pages, url, html), "edges")), "aliases")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = roots.select("node", "root", best_rule(host_of(as_url), path_of(as_url), rules).getField("verdict").alias("said"))
    # "allow" comes before "block" in the alphabet, so the smallest verdict has precedence.
    decided = ruled.groupBy("root").agg(F.min("said").alias("shared"))
    aliases = ruled.select("node", "root").join(decided, "root")
    return judged.join(aliases, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "shared", F.lit(default)).alias("verdict"),
        F.col("root").alias("component"),
    )
