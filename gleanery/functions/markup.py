"""Wiki markup: native expressions for what is regular, a scanner for what nests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from gleanery.cluster import ship

_TEMPLATES = ArrayType(StructType([StructField("named", MapType(StringType(), StringType())), StructField("positional", ArrayType(StringType()))]))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def snake_case(c: Column) -> Column:
    """Lower case, possessive 's joined, other runs to one underscore."""
    joined = F.regexp_replace(F.lower(c), "['’]s\\b", "s")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", "_"), F.lit("_"))


#: Leftover templates, quote marks, references, a fragment, and the page's own name in a page's text.
LEFTOVER, QUOTES = r"\{\{[^}]*\}\}", "'{2,3}"
REFERENCES = r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>|\{\{Refn\|[^}]*\}\}"
FRAGMENT = "#.*$"
OWN_NAME = ("{{PAGENAME}}", "{{PAGENAME")


def _pairs(c: Column, opens: str, closes: str, kept) -> Column:
    """What kept gives for the inside of every pair of marks, in its place; null, or marks that don't pair: as they were. Insides have no
    second closing sign, so the innermost pair counts."""

    def after(part: Column) -> Column:
        inside = F.substring_index(part, closes, 1)
        new = F.when(F.contains(part, F.lit(closes)) & ~F.contains(inside, F.lit(closes[0])), kept(inside))
        return F.coalesce(F.concat(new, F.substr(part, F.char_length(inside) + len(closes) + 1)), F.concat(F.lit(opens), part))

    parts = F.split(c, re.escape(opens))
    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), after), ""))


def _label(inside: Column) -> Column:
    return F.substr(inside, F.instr(inside, "|") + 1)


def _without(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def strip_markup(c: Column) -> Column:
    """Links to their labels; templates and quote marks go."""
    return strip(_without(_pairs(c, "[[", "]]", _label), LEFTOVER, QUOTES))


def strip_links(c: Column) -> Column:
    """Links to their targets."""
    return _pairs(c, "[[", "]]", lambda inside: F.substring_index(inside, "|", 1))


def strip_plinks(c: Column) -> Column:
    """Picture links to the name they show."""

    def name(inside: Column) -> Column:
        parts = F.split(inside, r"\|")
        return F.when(F.lower(F.get(parts, 0)).eqNullSafe("plink") & (F.get(parts, 1) != ""), F.get(parts, 1))

    return _pairs(c, "{{", "}}", name)


def strip_refs(c: Column) -> Column:
    return strip(_without(c, REFERENCES))


def clean_reference(c: Column, page: Column | None = None) -> Column:
    """The page's own name put in, then fragment and leftover templates cut."""
    for said in OWN_NAME if page is not None else ():
        c = F.replace(c, F.lit(said), page)
    return strip(_without(c, FRAGMENT, LEFTOVER[:-2] + r"\}?"))


def slug(c: Column) -> Column:
    return F.replace(strip(c), F.lit(" "), F.lit("_"))


def intro(c: Column) -> Column:
    """What stands before the first heading."""
    return strip(F.get(F.split(c, r"(?m)^==", 2), 0))


def heading_depth(c: Column) -> Column:
    """Number of equal signs that open a heading line; 0 for other lines."""
    return F.length(F.regexp_extract(c, r"^(=+)[^=].*=+\s*$", 1))


def floor_of(c: Column) -> Column:
    """Plane from a floor note: 1st floor is 1, ground floor and none 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+)(?:st|nd|rd|th) floor", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0))


def content_tag(c: Column, categories: list[str]) -> Column:
    """category:name as a struct, null if it isn't one of a known category."""
    parts = F.split(c, ":", 2)
    ok = (F.size(parts) == 2) & F.get(parts, 0).isin(categories) & (F.get(parts, 1) != "")
    return F.when(ok, F.struct(F.get(parts, 0).alias("category"), F.get(parts, 1).alias("name")))


def has_word(c: Column, word: str) -> Column:
    return c.rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])")


def truncated(c: Column, width: int) -> Column:
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def row_text(id_: Column, depth: Column, text: Column) -> Column:
    """Zero-padded id, indent, text."""
    return F.concat(F.lpad(id_.cast("string"), 4, "0"), F.lit(" "), F.repeat(F.lit("  "), depth), text)


# --- what nests ------------------------------------------------------------------------------------------------------


def balanced(text: str, start: int = 0, opens: str = "{{", closes: str = "}}") -> int:
    """Place after the mark that closes the one at `start`; -1 if none does."""
    depth, at = 0, start
    step = re.compile(f"{re.escape(opens)}|{re.escape(closes)}")
    while m := step.search(text, at):
        depth += 1 if m[0] == opens else -1
        at = m.end()
        if depth == 0:
            return at
    return -1


def templates(text: str, name: str) -> Iterator[str]:
    """Bodies of all templates of a name, marks left out, in order."""
    at = 0
    head = re.compile(r"\{\{\s*" + re.escape(name) + r"\s*(?=[|}])", re.IGNORECASE)
    while m := head.search(text, at):
        end = balanced(text, m.start())
        if end < 0:
            return
        yield text[m.end() : end - 2].lstrip("|")
        at = end


def split_top(body: str, mark: str = "|") -> list[str]:
    """Parts between marks that aren't inside a template or link."""
    parts, depth, last, at = [], 0, 0, 0
    while at < len(body):
        pair = body[at : at + 2]
        if pair in ("{{", "[["):
            depth, at = depth + 1, at + 2
        elif pair in ("}}", "]]"):
            depth, at = max(0, depth - 1), at + 2
        else:
            if depth == 0 and body.startswith(mark, at):
                parts.append(body[last:at])
                last = at + len(mark)
            at += 1
    return [*parts, body[last:]]


def parameters(body: str) -> tuple[dict[str, str], list[str]]:
    """Named and positional parameters of a template's body. Empty named ones are left out."""
    named, positional = {}, []
    for part in split_top(body):
        key, eq, value = part.partition("=")
        if eq and "{" not in key and "[" not in key:
            if value.strip():
                named[key.strip()] = value.strip()
        else:
            positional.append(part.strip())
    return named, positional


def versioned(named: dict[str, str], key: str, version: int) -> str | None:
    """A parameter of one version, or the one for all."""
    return named.get(f"{key}{version}", named.get(key))


def template_rows(text: Column | str, name: Column) -> Column:
    """All templates of a name as named and positional parameters."""
    ship()
    return _template_rows(text, name)


@F.pandas_udf(_TEMPLATES)
def _template_rows(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("named", "positional"), parameters(b))) for b in templates(t or "", n)] for t, n in zip(text, name)])


_INNER = re.compile(r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}")


def expand(text: str) -> str:
    """Innermost templates expanded until nothing changes: sic and colour keep their text, gender and random lines their
    first choice, plinks their name; unknown ones go. Then links, bold and italics."""

    def one(m: re.Match) -> str:
        name, parts = m[1].strip().lower(), [p for p in m[2].split("|")[1:] if "=" not in p]
        if name in ("sic", "mes", "overhead"):
            return parts[0] if parts else ""
        if name in ("colour", "color"):
            return parts[-1] if parts else ""
        return parts[0] if parts and name in ("plink", "trandom", "gender", "tmissing") else ""

    while (new := _INNER.sub(one, text)) != text:  # every round takes a pair of braces away
        text = new
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    return re.sub(r"'{2,3}", "", text).strip()


def expanded(text: Column | str) -> Column:
    ship()
    return _expanded(text)


@F.pandas_udf(StringType())
def _expanded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else expand(t))


def section(c: Column, name: str) -> Column:
    """What a parameter of a page's template holds, up to the next mark of its own level."""
    ship()
    return _section(c, F.lit(name))


@F.pandas_udf(StringType())
def _section(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([section_of(t or "", n) for t, n in zip(text, name)])


def section_of(text: str, name: str) -> str | None:
    head = re.search(r"\|\s*" + re.escape(name) + r"\s*=\s*", text)
    if not head:
        return None
    depth, at = 0, head.end()
    for m in re.compile(r"\{\{|\[\[|\}\}|\]\]|\|").finditer(text, head.end()):
        if depth == 0 and m[0] in ("|", "}}"):
            at = m.start()
            break
        depth += {"{{": 1, "[[": 1, "}}": -1, "]]": -1}.get(m[0], 0)
        at = len(text)
    return text[head.end() : at].strip() if at > head.end() else None


def typed_links(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, text) with every link [label](wiki:name) whose name is known (name in lower case, type) made [label](type:name). The names that texts
    link to are found first and joined, so the dictionary stays where it is."""
    pattern = r"\[([^\]]+)\]\(wiki:((?:[^()]|\([^)]*\))+)\)"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    asked = df.select(F.explode(F.array_distinct(names)).alias("said")).distinct().withColumn("name", F.lower("said"))
    types = asked.join(known, "name").groupBy("said").agg(F.min("type").alias("type"))
    linked = df.select(key, F.explode(F.array_distinct(names)).alias("said")).join(types, "said")
    own = linked.groupBy(key).agg(F.collect_list(F.struct("said", "type")).alias("links"))
    put = lambda t, x: F.replace(t, F.concat(F.lit("](wiki:"), x["said"], F.lit(")")), F.concat(F.lit("]("), x["type"], F.lit(":"), x["said"], F.lit(")")))
    return df.join(own, key, "left").select(key, F.when(F.col("links").isNull(), F.col(text)).otherwise(F.aggregate("links", F.col(text), put)).alias(text))


_ROWS = ArrayType(ArrayType(StringType()))


def table_rows(c: Column | str) -> Column:
    """Cells of every row of the first wiki table of a text, headings left out, marked up as they were."""
    ship()
    return _table_rows(c)


@F.pandas_udf(_ROWS)
def _table_rows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: wiki_table(t or ""))


def wiki_table(text: str) -> list[list[str]]:
    start, end = text.find("{|"), text.find("|}")
    rows: list[list[str]] = []
    if start < 0:
        return rows
    for block in re.split(r"(?m)^\|-.*$", text[start : end if end >= 0 else len(text)])[1:]:
        cells = [c.strip() for line in re.split(r"(?m)^\|(?![-}])", block)[1:] for c in line.split("||")]
        if cells:
            rows.append(cells)
    return rows


def html_rows(c: Column | str) -> Column:
    """Texts of the data cells of every table row in a page."""
    ship()
    return _html_rows(c)


@F.pandas_udf(_ROWS)
def _html_rows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html_table(t or ""))


def html_table(text: str) -> list[list[str]]:
    from html.parser import HTMLParser

    rows: list[list[str]] = []

    class Cells(HTMLParser):
        open_ = False

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                rows.append([])
            self.open_ = tag == "td" or self.open_ and tag not in ("tr", "th")
            if tag == "td" and rows:
                rows[-1].append("")

        def handle_endtag(self, tag):
            self.open_ = self.open_ and tag not in ("td", "tr", "table")

        def handle_data(self, data):
            if self.open_ and rows and rows[-1]:
                rows[-1][-1] += data

    parser = Cells()
    parser.feed(text)
    parser.close()
    return [[c.strip() for c in r] for r in rows if r]
