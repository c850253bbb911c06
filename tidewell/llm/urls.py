"""URL filter whose block decisions travel along redirects and canonical links.

Only DataFrame functions: a rule decides first; a URL that no rule fits takes the
decision of its component, the URLs tied to it by redirects or canonical links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)[\s"']href\s*=\s*["']?([^\s>"']+)"""
REFRESH_URL = r"""(?i)[\s"';]url\s*=\s*["']?([^\s>"';]+)"""
#: A list of so many rules is compiled into one expression; a longer one is joined by host.
COMPILED_RULES = 50

Rule = tuple[str, str, str]  # verdict, host, path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as a struct, or null; of equal lengths allow first, then by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))

    def fits(r: Rule) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    kind = "struct<rule:string,verdict:string>"
    tests = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered]
    return F.coalesce(*tests) if tests else F.lit(None).cast(kind)


def with_rules(urls: DataFrame, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """``urls(host, path, ...)`` with ``hit``, the struct of rule and verdict of the longest rule that fits, or null.

    A rule table ``(verdict, host, path)`` may be of any size. Each different host
    and path meets the rules of its host and of the domains above it, so a URL row
    is shuffled once and a host gives no more rows than it has labels.
    Of rules of one length that fit, an allowing one counts, then the first by text.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED_RULES:
            return urls.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    listed = rules.select("verdict", F.col("host").alias("domain"), F.col("path").alias("start"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("domain", F.explode(above))
    fits = asked.join(listed, "domain").where(F.startswith("path", "start"))
    rule = F.concat("domain", "start")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), "verdict", rule.alias("rule"))).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct("best.rule", "best.verdict").alias("hit"))
    return urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")


def without_dots(url: Column) -> Column:
    """An absolute URL with the segments ``.`` and ``..`` of its path resolved."""
    head, path, rest = (F.regexp_extract(url, "^([^/?#]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    steps = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    found = F.concat(F.aggregate(F.slice(steps, 2, F.greatest(F.lit(0), F.size(steps) - 1)), F.lit(""), step), F.when(path.rlike("/[.][.]?$"), "/").otherwise(""))
    return F.when(path.rlike("/[.][.]?(/|$)"), F.concat(head, found, rest)).otherwise(url)


def url_key(url: Column) -> Column:
    """The URL as a node: no fragment, scheme and host lower-cased; null without ``://``."""
    whole = F.regexp_extract(url, "^[^#]*", 0)
    head = F.regexp_extract(whole, "^[^/?#]*://[^/?#]*", 0)
    return F.when(F.length(head) > 0, F.concat(F.translate(head, UPPER, UPPER.lower()), whole.substr(F.length(head) + 1, F.length(whole))))


def _resolved(parts: DataFrame) -> DataFrame:
    """``(a, b)`` from ``(a, head, scheme, folder, link)``: links as absolute URLs, seen from a page."""
    link = F.col("link")
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat("scheme", link))
        .when(link.startswith("/"), F.concat("head", link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat("head", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), link))
    )
    return parts.select("a", whole.alias("to")).select("a", without_dots(F.col("to")).alias("to")).select("a", url_key(F.col("to")).alias("b"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: each page's URL and where its canonical link or refresh leads."""
    url, html = F.col(url_col), F.col(html_col)
    # One projection per step: each regular expression is then compiled and run once.
    likely = pages.where(html.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.regexp_extract(html, CANONICAL, 0).alias("c"), F.regexp_extract(html, REFRESH, 0).alias("r"))
    raw = likely.select("url", F.explode(F.array(F.regexp_extract("c", HREF, 1), F.regexp_extract("r", REFRESH_URL, 1))).alias("link")).where("link <> ''")
    parts = raw.select(
        url_key(F.col("url")).alias("a"), F.regexp_extract("url", "^[^/?#]*://[^/?#]*", 0).alias("head"), F.regexp_extract("url", "^[^/?#]*:", 0).alias("scheme"),
        F.regexp_replace(path_of(F.col("url")), "[^/]*$", "").alias("folder"), F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"),
    )
    return _resolved(parts).where("a is not null and b is not null and a <> b").distinct()


def url_filter(
    pages: DataFrame, rules: DataFrame | Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """``(<id>, host, path, rule, verdict)`` for every page.

    ``rules`` are (allow or block, host, path), in a list or a table of any size
    with the columns ``verdict, host, path``: a rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins. Without one,
    a page takes its component's decision: allow if a rule allows any URL of it,
    else block if a rule blocks any, else allow. Components tie URLs (fragment
    ignored) by canonical links and refreshes in ``html_col`` and by the rows of
    ``redirects(from_url, to_url)``.

    Null url, or one without ``://``: empty host and path, no rule, allow. Null
    html has no links. Repeated rows repeat in the result; an empty table gives an
    empty result; extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    links = page_links(base)
    if redirects is not None:
        links = links.union(redirects.select(url_key(F.col("from_url")), url_key(F.col("to_url"))))
    links = scratch.save(links, "links")
    judged = base.select("id", url_key(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rules(judged, rules)
    verdict = F.coalesce("hit.verdict", F.lit("allow"))
    if not links.isEmpty():
        roots = components(links, scratch)
        parts = roots.select("root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
        ruled = with_rules(parts, rules).groupBy("root").agg(F.min("hit.verdict").alias("theirs"))  # allow sorts before block
        judged = judged.join(roots.join(ruled, "root").select("node", "theirs"), "node", "left")
        verdict = F.coalesce("hit.verdict", "theirs", F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
