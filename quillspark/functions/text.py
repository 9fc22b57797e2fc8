"""Text expressions: normalising, tokens, edit distances, names and formats."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes of LaTeX's special characters (fixed values).
LATEX = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_",
    "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}
#: The first of the characters that stand for tokens, and their number: all beyond the basic plane, each one character of a text.
FIRST_TOKEN, MOST_TOKENS = 0x10000, 0x100000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """Runs of white space, as Unicode and the separators 0x1C-0x1F have it, as one blank; trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(normal: Column | str) -> Column:
    """Words of a normalised text; none of an empty one."""
    return F.filter(F.split(col(normal), " "), lambda t: t != "")


def edits(a: Column | str, b: Column | str) -> Column:
    return F.when(col(a) == col(b), F.lit(0)).otherwise(F.levenshtein(col(a), col(b)))


def within(a: Column | str, b: Column | str, k: int = 1) -> Column:
    """Whether the texts are at most k edits apart; the distance is not computed further than that."""
    if k < 0:
        raise ValueError("tolerance must not be negative")
    return F.levenshtein(col(a), col(b), k).between(0, k)


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: each distinct token becomes one character."""
    known = F.array_distinct(F.concat(a, b))

    def encoded(tokens: Column) -> Column:
        code = lambda t: F.lpad(F.hex((F.array_position(known, t) + (FIRST_TOKEN - 1)).cast("long")), 8, "0")
        return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(code(t)), "UTF-32")), "")

    few = F.size(known) <= MOST_TOKENS
    distance = F.when(few, edits(encoded(a), encoded(b))).otherwise(F.raise_error(F.lit("over a million distinct tokens in one pair")))
    return F.when(a == b, F.lit(0)).otherwise(distance)


def stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def sample_ids(name: Column | str) -> tuple[Column, Column]:
    """(document_id, line_id) of `<document>_<number>.<ext>`; (stem, "0") of any other name."""
    s = stem(name)
    fits = s.rlike(r"^(.+)_(\d+)$")
    return F.when(fits, F.regexp_extract(s, r"^(.+)_(\d+)$", 1)).otherwise(s), F.when(fits, F.regexp_extract(s, r"^(.+)_(\d+)$", 2)).otherwise("0")


def safe_name(text: Column | str) -> Column:
    """A name of A-Z, a-z, 0-9, dot, underscore and hyphen; `unnamed` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9._-]", "_"), "_+", "_")
    plain = F.regexp_replace(plain, r"^_+|_+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "unnamed").otherwise(plain)


def latex_escape(text: Column | str) -> Column:
    """Each special character once; the escapes are not escaped again."""
    table = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    return F.array_join(F.transform(F.split(col(text), ""), lambda c: F.coalesce(table[c], c)), "")


def latex(text: str | None) -> str:
    """The same for a text of the driver."""
    return "".join(LATEX.get(c, c) for c in text or "")


def four_decimals(value: object) -> str:
    """The same as `format_number` for a value of the driver; what is no number stays as it is."""
    try:
        number = float("nan") if value is None else float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return str(value)
    return f"{number:.4f}" if isfinite(number) else "n/a"


def format_number(value: Column | str) -> Column:
    """Four decimals, or n/a where there is no finite number."""
    v = col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, F.format_string("%.4f", v)).otherwise("n/a")


def clean_generated(text: Column | str, prompt: str, image_token: str = "<image>") -> Column:
    """Generated text without image tokens, a leading prompt, or what stands before the assistant's mark."""
    plain = F.trim(F.replace(col(text), F.lit(image_token), F.lit("")))
    if prompt:
        plain = F.when(plain.startswith(prompt), F.trim(F.substring(plain, len(prompt) + 1, 1 << 30))).otherwise(plain)
    mark = "Assistant:"
    before = F.lower(F.substring_index(plain, mark, 1))
    alike = (F.lit(prompt.lower()).contains(F.trim(before)) | before.contains("user:")) & plain.contains(mark)
    return F.when(alike, F.trim(F.substring(plain, (F.locate(mark, plain) + len(mark)).cast("int"), F.lit(1 << 30)))).otherwise(plain)


def first_key(json: Column | str, keys: tuple[str, ...] = ("sentence", "text", "label", "value"), inside: tuple[str, ...] = ("", "[0]", ".result", ".prediction", "[0][0]")) -> Column:
    """The first of the keys that a JSON object has, or the objects in it; a plain JSON text is its own value."""
    at = [F.get_json_object(col(json), f"${place}.{k}") for place in inside for k in keys]
    plain = F.when(F.trim(col(json)).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), col(json), F.lit("}")), "v string")["v"])
    return F.coalesce(*at, plain)


def joined(parts: Column, sep: str = " ") -> Column:
    """Trimmed parts that are not empty."""
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), sep)


def in_order(order: list[Column], value: Column, sep: str) -> Column:
    """Aggregate: the values joined in the order of the key, whatever order the shuffle left."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def page_texts(df: DataFrame, page: list[str], line: str, order: str, text: str) -> DataFrame:
    """page and `text`: trimmed lines joined by line breaks, parts of a page (`line`) by empty lines, both in order."""
    parts = df.groupBy(*page, line).agg(in_order([F.col(order)], F.trim(F.coalesce(text, F.lit(""))), "\n").alias("_part"))
    return parts.groupBy(*page).agg(in_order([F.col(line)], F.col("_part"), "\n\n").alias("text"))


def base64_of(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(data), "\r\n", "")


def decoded(text: Column) -> Column:
    """Bytes of a base64 text; null if it is none."""
    return F.try_to_binary(text, F.lit("base64"))
