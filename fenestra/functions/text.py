"""Text as columns: names without name spaces, references, booleans, identities, terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no value, and those that stand for true, by source.
EMPTY = ("", "@null", "@empty")
TRUE_WORDS = {"plain": ("true",), "loose": ("1", "true", "yes"), "label": ("yes",)}


def local_name(name: Column | str) -> Column:
    """Without name space and package: {ns}a.b.Name gives Name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.element_at(F.split(F.element_at(F.split(c, r"\}"), -1), r"\."), -1)


def is_empty(value: Column) -> Column:
    text = F.trim(value)
    return value.isNull() | text.isin(*EMPTY) | (F.lower(text) == "null")


def non_empty(value: Column) -> Column:
    return F.when(~is_empty(value), value)


def truth(value: Column, source: str = "plain") -> Column:
    """Whether a cell says true, by the words of its source; null and other texts say no."""
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS[source]), F.lit(False))


def reference(value: Column, kind: str) -> Column:
    """The name in @kind/name or @+kind/name, else null."""
    name = F.regexp_extract(F.trim(value), rf"^@(?:\+)?{kind}/([A-Za-z0-9_.]+)$", 1)
    return F.when(name != "", name)


def ends_with_any(tag: Column, suffixes) -> Column:
    return reduce(lambda a, b: a | b, (tag.endswith(s) for s in sorted(suffixes)))


def view_type(tag: Column) -> Column:
    """The class of a widget by its name's end; earlier lines win."""
    return (
        F.when(tag.endswith("ImageButton"), "ImageButton")
        .when(tag.endswith("AutoCompleteTextView"), "SelectionControl")
        .when(tag.endswith("EditText"), "EditText")
        .when(tag.endswith("Spinner"), "SelectionControl")
        .when(tag.endswith("Button"), "Button")
        .when(tag.endswith("ImageView"), "ImageView")
        .when(ends_with_any(tag, ("RadioGroup", "CheckBox", "Switch", "SeekBar", "RatingBar")), "SelectionControl")
        .when(tag.endswith("TextView"), "TextView")
        .otherwise(tag)
    )


def term_pattern(terms) -> str:
    """A pattern for any of the terms: between other letters and digits for Latin ones, anywhere for Chinese ones."""
    parts = []
    for term in sorted(t.lower() for t in terms):
        if any("一" <= c <= "鿿" for c in term):
            parts.append(term)
            continue
        words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in term).split()]
        if words:
            parts.append(r"(?<![a-z0-9])" + r"[\s_-]+".join(words) + r"(?![a-z0-9])")
    return "|".join(parts)


def has_term(text: Column, terms) -> Column:
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    plain = F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[_./:@+\-]+", " "), r"\s+", " ")
    return F.coalesce(plain.rlike(term_pattern(terms)), F.lit(False))


def name_tokens(text: Column) -> Column:
    """Lower-case letters-and-digits runs, split where case rises too."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), F.lit(r"[a-z0-9]+"), F.lit(0))


def repository_url(value: Column, rewrite_ssh: bool = True) -> Column:
    """An identity for a repository: lower case, without protocol details, .git and the last slash."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    text = F.regexp_replace(text, r"^git@([^:]+):", "https://$1/") if rewrite_ssh else text
    return F.regexp_replace(F.regexp_replace(text, r"/+$", ""), r"\.git$", "")


def identity(value: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def layout_path(path: Column) -> Column:
    """A layout's path without its configuration's qualifiers."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)layout-[^/]+/", "$1layout/")


def resource_path(path: Column) -> Column:
    """What follows the last /res/ of a path."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/res/", -1)


def without_tags(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, r"(?s)<[^>]*>", " "), r"\s+", " "))


def escaped(value: Column) -> Column:
    """For a double-quoted attribute."""
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def stable_key(seed: str | int, *parts: Column | str) -> Column:
    """A pseudo-random, repeatable order: the hash of a seed and the row's identity."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts)), 256)


def version_key(version: Column) -> Column:
    """An array that sorts dotted numbers as numbers."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


CHINESE = r"[\x{4e00}-\x{9fff}]"


def split_keywords(words: Column) -> tuple[Column, Column]:
    """(words without, words with Chinese characters), each once and in order; a null array gives empty ones."""
    words = F.coalesce(words, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike(CHINESE))), F.array_distinct(F.filter(words, lambda w: w.rlike(CHINESE)))


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: without its fence; if prose stands before it, what is between the outermost braces. Null if that doesn't parse."""
    plain = F.trim(F.regexp_replace(F.trim(reply), r"^```[^\n]*\n|\n```[^\n]*$", ""))
    inner = F.when(plain.startswith("{"), plain).otherwise(F.regexp_extract(plain, r"(?s)(\{.*\})", 1))
    # Spark's parsers stop after the first value: what follows it would break one of these two.
    whole = (F.json_array_length(F.concat(F.lit("["), inner, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), inner, F.lit("}"))).isNotNull()
    return F.when((inner != "") & whole, inner)


def number(cell: Column, blank: float = 0.0) -> Column:
    """A cell as a number; blank cells and null count as given, other texts as null."""
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", blank).otherwise(F.trim(cell).try_cast("double"))
