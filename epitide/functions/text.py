"""Column functions for dirty text: blanks, codes, dates, numbers, keywords, prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epitide import schema

TRUE_WORDS = ("1", "true", "yes", "y")  # fixed values


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trim; an empty string becomes null."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def iso3(c: Column | str) -> Column:
    """Upper-case three-letter code, null when the text is anything else."""
    code = F.upper(F.trim(_col(c)))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def parse_date(c: Column | str, *formats: str) -> Column:
    """First layout that parses wins; null when none does."""
    text = F.trim(_col(c))
    return F.coalesce(*(F.try_to_date(text, f) for f in formats or ("yyyy-MM-dd",)))


def parse_timestamp(c: Column | str, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(_col(c))


def parse_number(c: Column | str) -> Column:
    """Text to double, null when it is not a number."""
    return F.trim(_col(c)).try_cast("double")


def parse_grouped_number(c: Column | str) -> Column:
    """Like :func:`parse_number`, ignoring thousands separators."""
    return F.replace(F.trim(_col(c)), F.lit(","), F.lit("")).try_cast("double")


def is_enabled(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))).isin(*TRUE_WORDS), F.lit(False))


def first_non_empty(*candidates: Column | str) -> Column:
    """First candidate that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in candidates))


def canonical_name(c: Column | str, aliases: dict[str, list[str]]) -> Column:
    """Alias to canonical name, ignoring case; an unknown name passes through trimmed."""
    lookup: dict[str, str] = {}
    for name, words in aliases.items():
        for word in (name, *words):
            lookup[word.strip().lower()] = name
    table = F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair))
    text = blank_to_null(c)
    return F.coalesce(F.try_element_at(table, F.lower(text)), text)


def unmapped_key(code: Column | str, name: Column | str) -> Column:
    """Location code, or a synthetic key that keeps unmapped names apart."""
    return F.coalesce(_col(code), F.concat(F.lit("UNMAPPED:"), _col(name)))


def extract_field(c: Column | str, pattern: str, dtype: str = "string", group: int = 1) -> Column:
    """Regex group as a typed value, null without a match."""
    hit = F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))
    return hit if dtype == "string" else hit.try_cast(dtype)


def extract_fields(c: Column | str, fields: dict[str, tuple[str, str]]) -> list[Column]:
    return [extract_field(c, pattern, dtype).alias(name) for name, (pattern, dtype) in fields.items()]


def period_label(year: Column, week: Column, month: Column) -> Column:
    """``YYYY-Www`` when a week is known, else ``YYYY-MM``, else null."""
    return (
        F.when(year.isNotNull() & week.isNotNull(), F.format_string("%d-W%02d", year, week))
        .when(year.isNotNull() & month.isNotNull(), F.format_string("%d-%02d", year, month))
    )


def classify(c: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose phrase occurs in the text."""
    text = _col(c)
    labels = [F.when(text.contains(phrase), F.lit(label)) for phrase, label in rules]
    return F.coalesce(*labels, F.lit(default))


def _quote(term: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in term)


def matches_term(c: Column | str, term: str) -> Column:
    """Whole-term match: 'flu' does not hit 'fluoride'."""
    word = _quote(term.lower().strip())
    return F.lower(_col(c)).rlike(f"(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])")


def matches_any_term(c: Column | str, terms: list[str]) -> Column:
    """One pass over the text for a whole list of terms."""
    words = "|".join(_quote(t.lower().strip()) for t in terms)
    return F.lower(_col(c)).rlike(f"(?<![A-Za-z0-9])(?:{words})(?![A-Za-z0-9])")


def infer_unit(name: Column | str) -> Column:
    text = F.lower(_col(name))

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, (text.contains(w) for w in words))

    # Phrases that reveal the unit, most specific first.
    return (
        F.when(has("per 100 000", "per 100,000"), "per_100k")
        .when(has("percent", "(%)"), "percent")
        .when(has("number", "cases", "diagnosis"), "count")
        .when(has("rate"), "rate")
        .otherwise("unspecified")
    )


def resolve_unit(unit: Column | str, code: Column | str, name: Column | str, overrides: dict[str, str]) -> Column:
    """Explicit override by code, else the given unit, else the inferred one."""
    table = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
    return F.coalesce(F.try_element_at(table, _col(code)), _col(unit), infer_unit(name))


def topic_matches(topic: Column | str, code: Column | str, name: Column | str) -> Column:
    """Does the indicator really belong to the topic it was collected for?"""
    topic, code, text = _col(topic), F.upper(_col(code)), F.lower(_col(name))
    by_code = [(topic == t) & code.startswith(p) for t, p in schema.TOPIC_CODE_PREFIX.items()]
    by_name = [(topic == t) & text.rlike(p) for t, p in schema.TOPIC_PATTERNS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, by_code + by_name), F.lit(False))


def usage_class(topic: Column | str, code: Column | str, name: Column | str, matches: Column | None = None) -> Column:
    """How an indicator may be used; `matches` is a topic match that is already known."""
    topic, code = _col(topic), _col(code)
    matches = topic_matches(topic, code, name) if matches is None else matches
    auxiliary = [schema.PREVALENCE_INDICATOR, *schema.AUXILIARY_INDICATORS]
    return (
        F.when(code == schema.PRIMARY_INDICATOR, "primary_hiv_observation")
        .when(code.isin(*auxiliary), "auxiliary_feature")
        .when(F.upper(code).startswith("PRISON_"), "special_population_reference")
        .when((topic != "unknown") & ~matches, "keyword_false_positive")
        .otherwise("catalog_only")
    )


def discover_topics(df: DataFrame, code: str, name: str, topics: dict[str, list[str]]) -> DataFrame:
    """Catalog entries per topic: any keyword in code or name, one row per (topic, code).

    All topics are tested in one pass over the row; only hits become rows.
    """
    blob = F.concat_ws(" ", F.col(code), F.coalesce(F.col(name), F.lit("")))
    hits = F.array(*(F.when(matches_any_term(blob, words), F.lit(topic)) for topic, words in topics.items()))
    rows = df.where(blank_to_null(code).isNotNull()).select(code, name, F.explode(F.array_compact(hits)).alias("topic"))
    return rows.groupBy("topic", code).agg(F.max(name).alias(name))


def link_candidates(df: DataFrame, url: str, html: str, keywords: list[str], host_suffix: str) -> DataFrame:
    """Links whose text holds a keyword and whose host ends with the suffix, one row per target."""
    rows = df.select(F.col(url).alias("_base"), F.explode(anchors(html)).alias("_a"))
    wanted = reduce(lambda a, b: a | b, (F.col("_a.text").contains(k) for k in keywords))
    found = rows.where(wanted).select(resolve_link("_base", "_a.href").alias("detail_url"), F.col("_a.text").alias("anchor_title"))
    host = F.regexp_extract("detail_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return found.where(host.endswith(host_suffix)).groupBy("detail_url").agg(F.max("anchor_title").alias("anchor_title"))


def attachment_links(url: Column | str, html: Column | str) -> Column:
    """Sorted unique absolute links to documents; only those are resolved."""
    hrefs = F.regexp_extract_all(_col(html), F.lit(HREF_PATTERN), 1)
    documents = F.array_distinct(F.filter(hrefs, lambda h: h.rlike(schema.ATTACHMENT_PATTERN)))
    return F.array_sort(F.array_distinct(F.transform(documents, lambda h: resolve_link(url, h))))


def page_metadata(df: DataFrame, url: str, html: str, preview: int) -> DataFrame:
    """Title, first date, document links and a preview of so many characters of HTML pages.

    The visible text is a column of its own, so the page is stripped once and not per field.
    """
    staged = df.withColumns({"_text": strip_tags(html), "attachment_urls": attachment_links(url, html), "title": page_title(html)})
    return staged.withColumns({
        "published_date": first_date("_text"), "text_preview": F.substring("_text", 1, preview), "text_chars": F.length("_text"),
    }).drop("_text")


def page_role(url: Column | str) -> Column:
    return F.when(_col(url).endswith("/"), "listing").otherwise("detail")


# Character references met in report pages; the ampersand is decoded last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
HIDDEN_HTML = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(html: Column | str) -> Column:
    """Visible text: scripts, styles and comments dropped, tags to line breaks."""
    body = F.regexp_replace(_col(html), HIDDEN_HTML, "")
    lines = F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]*>", "\n"), r"\s*\n\s*", "\n")
    return decode_entities(F.regexp_replace(lines, r"^\s+|\s+$", ""))


def page_title(html: Column | str) -> Column:
    """Text of the first h1/h2, else of the title element."""
    html = _col(html)

    def inner(pattern: str) -> Column:
        text = F.regexp_replace(F.regexp_extract(html, pattern, 1), "(?s)<[^>]*>", " ")
        return decode_entities(blank_to_null(F.regexp_replace(text, r"\s+", " ")))

    return F.coalesce(
        inner(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), inner(r"(?is)<title[^>]*>(.*?)</title>"), F.lit("")
    )


def first_date(text: Column | str) -> Column:
    """First date-like group in running text as ``YYYY-MM-DD``."""
    parts = F.split(F.regexp_extract(_col(text), schema.PAGE_DATE_PATTERN, 0), r"\D+")
    y, m, d = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(y.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d))


HREF_PATTERN = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>"""


def anchors(html: Column | str) -> Column:
    """Array of (href, text) of every link."""
    html = _col(html)
    pattern = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    hrefs = F.regexp_extract_all(html, pattern, 1)
    texts = F.transform(
        F.regexp_extract_all(html, pattern, 2),
        lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]*>", " "), r"\s+", " ")),
    )
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on a page."""
    base, href = _col(base), _col(href)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
