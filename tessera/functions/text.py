"""Text functions: column in, column out, all of Spark's own expressions but for character references."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import vocabulary as V

_SPACE = r"[\s　 \u0085\u001c-\u001f -      ]"


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def literal_map(values: Mapping[str, str | None]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def strip(x: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def strip_chars(x: Column, chars: str) -> Column:
    kind = "".join(f"\\{c}" if c in r"\]^-[" else c for c in chars)
    return F.regexp_replace(x, f"^[{kind}]+|[{kind}]+$", "")


def normal_name(x: Column) -> Column:
    """A name as the fusion tables have it: stripped, lower case."""
    return F.lower(strip(x))


#: A character reference that ends in a semicolon.
_ENDED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """All character references of HTML, named and numbered. There are over two thousand names, some of them without a
    semicolon, so this is the standard library's work; texts without an ampersand come as nulls."""
    return texts.map(html.unescape, na_action="ignore")


def _unescape_ended(text: str) -> str:
    return _ENDED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text)


@F.pandas_udf(StringType())
def _unescaped_ended(texts: pd.Series) -> pd.Series:
    """Those references alone that end in a semicolon."""
    return texts.map(_unescape_ended, na_action="ignore")


def clean_str(x: Column, ended: bool = False) -> Column:
    """Stripped, character references resolved (with ``ended`` only those that end in a semicolon: of a text that was cut
    within a reference the rest stays), control characters deleted."""
    bare = strip(x)
    resolve = _unescaped_ended if ended else _unescaped
    return F.regexp_replace(F.coalesce(resolve(F.when(bare.contains("&"), bare)), bare), r"[\x00-\x1f\x7f-\x9f]", "")


def graph_name(x: Column) -> Column:
    """A name as the retrieval graph has it: cleaned, upper case."""
    return F.upper(clean_str(x))


def fuzzy_key(x: Column) -> Column:
    """Lower case without white space, dashes, dots and brackets."""
    return F.regexp_replace(F.lower(x), r"[\s\-—_·・()（）\[\]【】]", "")


def remap(x: Column, values: Mapping[str, str | None], default: Column | str | None = None) -> Column:
    """The table's value; where it has none, ``default`` (None: the value itself)."""
    other = x if default is None else F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(literal_map(values), x), other)


def guideline_type(raw: Column, learned: Column | None = None) -> Column:
    """Raw type to one of the unified types: the table, a unified type in quotes, the table's quoted form,
    then ``learned`` (a model's answer), then the default."""
    bare = strip(strip_chars(raw, '"'))
    table = literal_map(V.GUIDELINE_TYPES)
    steps = [F.try_element_at(table, raw), F.when(bare.isin(*V.ENTITY_TYPES), bare), F.try_element_at(table, F.concat(F.lit('"'), bare, F.lit('"')))]
    return F.coalesce(*steps, *([learned] if learned is not None else []), F.lit(V.DEFAULT_TYPE))


def tail_type(relation: Column, head_type: Column, now: Column | None = None) -> Column:
    """The tail's type as its relation implies it; synonyms have the head's. ``now`` wins where it is set."""
    fixed = {k: v for k, v in V.TAIL_TYPES.items() if v is not None}
    same = [k for k, v in V.TAIL_TYPES.items() if v is None]
    found = F.when(relation.isin(*same), head_type).otherwise(F.try_element_at(literal_map(fixed), relation))
    return found if now is None else F.coalesce(F.nullif(now, F.lit("")), found)


def split_markers(x: Column, markers: Sequence[str]) -> Column:
    """Parts between markers, stripped, blank ones dropped."""
    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(x, pattern), strip), lambda p: p != "")


def float_or(x: Column, default: float = 1.0) -> Column:
    """The number, if the text is a plain decimal; else ``default``."""
    return F.when(F.coalesce(x.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), F.lit(False)), x.try_cast("double")).otherwise(F.lit(default))


def prefix(x: Column, n: int) -> Column:
    """The first n code points."""
    return F.left(x, F.lit(n))


def csv_section(header: Sequence[str], rows: Column, cells: Sequence[tuple[str, bool]]) -> Column:
    """Lines of cells: strings stripped of quotes and quoted, numbers bare. ``rows``: an array of structs;
    ``cells``: field and if it is text."""

    def line(r: Column) -> Column:
        return F.concat_ws(",\t", *(F.concat(F.lit('"'), F.regexp_replace(r[c].cast("string"), '^"+|"+$', ""), F.lit('"')) if quoted else r[c].cast("string") for c, quoted in cells))

    return F.concat_ws("\n", F.concat(F.array(F.lit(",\t".join(header))), F.transform(rows, line)))


# -- diagnoses in model answers


def clean_diagnosis(item: Column) -> Column:
    """A diagnosis without wrapping, trailing remarks and lead-in words; empty if it is no diagnosis."""
    chars = V.DIAGNOSIS_WRAPPING
    x = strip_chars(strip(item), chars)
    short = F.length(x) < 2
    x = strip(F.regexp_replace(x, V.DIAGNOSIS_REMARK, ""))
    x = strip(F.regexp_replace(x, f"^(?:{'|'.join(V.DIAGNOSIS_EXAMPLES)})\\s*", ""))
    x = strip_chars(strip(x), chars)
    drop = any_of([short, x.rlike(f"^(?:{'|'.join(V.DIAGNOSIS_SKIP_STARTS)})"), x.rlike("|".join(V.DIAGNOSIS_SKIP_PARTS)), x.rlike(V.DIAGNOSIS_OPEN_BRACKET), F.length(x) < 2])
    return F.when(drop, "").otherwise(x)


def extract_diagnoses(text: Column, labels: Sequence[str] = V.DIAGNOSIS_LABELS) -> Column:
    """Distinct diagnoses in order: those in brackets, then those after each label."""
    plain = F.regexp_replace(text, V.BOLD, "$1")
    plain = F.regexp_replace(plain, V.ITALIC, "$1")
    found = [F.regexp_extract_all(plain, F.lit(V.BRACKETED), F.lit(1))]
    found += [F.regexp_extract_all(plain, F.lit(label + V.AFTER_LABEL), F.lit(1)) for label in labels]
    items = F.flatten(F.transform(F.flatten(F.array(*found)), lambda m: F.split(m, V.DIAGNOSIS_SEPARATOR)))
    return F.array_distinct(F.filter(F.transform(items, clean_diagnosis), lambda d: d != ""))


def bracket_diagnoses(text: Column) -> Column:
    """Distinct stripped contents of square brackets."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(V.BRACKETED), F.lit(1)), strip))


def ground_truth(text: Column, labels: Sequence[str] = V.TRUTH_LABELS) -> Column:
    """What follows a label at the end of the text, else the bracketed items joined, else the text."""
    tries = [F.nullif(strip(F.regexp_extract(text, label + V.LAST_AFTER_LABEL, 1)), F.lit("")) for label in labels]
    brackets = F.regexp_extract_all(text, F.lit(V.BRACKETED), F.lit(1))
    joined = F.when(F.size(brackets) > 0, F.concat(F.lit("["), F.array_join(F.transform(brackets, strip), "], ["), F.lit("]")))
    return F.coalesce(*tries, joined, strip(text))


def option_letters(answer: Column, single: Column) -> Column:
    """The chosen letters A to F: sorted and distinct; for single choice the first of a pure answer (as
    typed), else the smallest; null where there are none."""
    bare = strip(answer)
    pure = bare.rlike("^[A-Fa-f]+$")
    letters = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(bare), F.lit("[A-F]"), F.lit(0)))), "")
    return F.when(letters == "", None).when(single & pure, F.upper(F.left(bare, F.lit(1)))).when(single, F.left(letters, F.lit(1))).otherwise(letters)


def format_options(options: Column) -> Column:
    """``k. v`` lines of the options that aren't blank, by key."""
    entries = F.array_sort(F.map_entries(F.map_filter(options, lambda _, v: F.coalesce(strip(v) != "", F.lit(False)))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def chat_prompt(system: Column, instruction: Column, user: Column) -> Column:
    """System, instruction and input; the system part is left out where the instruction starts with it."""
    head = F.when(instruction.startswith(system), instruction).otherwise(F.concat_ws("\n", system, instruction))
    return F.when(F.coalesce(user, F.lit("")) == "", head).otherwise(F.concat_ws("\n", head, user))


def report_markdown(title: Column, summary: Column, findings: Column) -> Column:
    """A community report as text. ``findings``: an array of structs summary, explanation."""
    parts = F.transform(findings, lambda f: F.concat(F.lit("## "), F.coalesce(f["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(f["explanation"], F.lit(""))))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), summary, F.lit("\n\n"), F.array_join(parts, "\n\n"))


# -- scanned pages


def is_structured_line(line: Column) -> Column:
    """A line that starts anew: bullets, numbers, headings, tables, capitals, or short."""
    s = strip(line)
    return any_of([
        *(s.rlike(p) for p in V.STRUCTURED_LINES),
        (s == F.upper(s)) & (s != F.lower(s)), F.length(s) < V.SHORT_LINE,
    ])


def normalise_lines(text: Column) -> Column:
    """Scanned lines joined to paragraphs: a line goes on the one before unless it is structured, the one
    before was, or that ends a sentence; blank lines part paragraphs."""

    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        fresh = (acc["open"] == "") | is_structured_line(line) | acc["open"].rlike(V.SENTENCE_END)
        return (
            F.when(line == "", F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.lit("").alias("open")))
            .when(fresh, F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), line.alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), line).alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(F.split(text, "\r?\n"), start, step, lambda acc: F.array_join(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])), "\n"))


def drop_repeated_paragraphs(text: Column, least: int = 50, separator: str = "\n") -> Column:
    """Paragraphs of ``least`` characters and more appear once, at their first place."""

    def step(acc: Column, p: Column) -> Column:
        repeated = (F.length(strip(p)) >= least) & F.array_contains(acc, p)
        return F.when(repeated, acc).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(F.split(text, separator), F.array().cast("array<string>"), step), separator)


def section_states(before: Column, after: Column) -> Column:
    """Of each audited section that was there: its name and if it is gone."""

    def there(x: Column, names: tuple[str, str]) -> Column:
        return F.lower(x).contains(names[0].lower()) | x.contains(names[1])

    return F.filter(F.array(*(F.when(there(before, s), F.struct(F.lit(s[0]).alias("section"), (~there(after, s)).alias("deleted"))) for s in V.AUDIT_SECTIONS)), lambda x: x.isNotNull())


def tokens(text: Column) -> Column:
    """The offline tokenizer: runs of characters that aren't white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")
