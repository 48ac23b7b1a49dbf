"""Numbers, classes and passages of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain lower-case forms.
_MARKED, _PLAIN = "çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosucgiosuaiuaiu"


def fold(text: Column) -> Column:
    """Lower case without marks, alike for dotted and dotless i."""
    return F.lower(F.translate(text, _MARKED, _PLAIN))


def upper_dotted(text: Column) -> Column:
    """Upper case with dotted and dotless i kept apart."""
    return F.upper(F.translate(text, "iı", "İI"))


def parse_number(text: Column) -> Column:
    """A number written with either separator; parentheses or a hyphen negate; dashes are 0; others null.

    The last of both separators is the decimal one. A single kind of separator groups
    thousands if it stands before three digits each time, else it is decimal.
    """
    t = F.regexp_replace(F.trim(text), r"[\s%]", "")
    negative = t.rlike(r"^\(.*\)$") | t.rlike(r"^-\d")
    d = F.regexp_replace(t, r"[()\-]", "")
    comma, dot = F.instr(F.reverse(d), ","), F.instr(F.reverse(d), ".")
    grouped = d.rlike(r"^\d{1,3}([.,]\d{3})+$")
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), F.replace(d, F.lit(","), F.lit("")))
        .when(grouped, F.regexp_replace(d, "[.,]", ""))
        .otherwise(F.replace(d, F.lit(","), F.lit(".")))
    )
    value = plain.try_cast("double")
    return F.when(t.rlike(r"^[-–—]+$"), F.lit(0.0)).when(plain.rlike(r"^\d+(\.\d+)?$"), F.when(negative, -value).otherwise(value))


def format_grouped(value: Column, decimals: int = 2) -> Column:
    """Dots between thousands and a decimal comma."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def numbers_in(text: Column) -> Column:
    """All numbers of a text as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first rule (class, pattern) that the text matches."""
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def roman(text: Column) -> Column:
    """The value of a Roman numeral; null for anything else."""
    t = F.upper(F.trim(text))
    worth = F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv))
    digits = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: worth[c])
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(t.rlike("^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (t != ""), total)


def power_of_ten(a: Column, b: Column, slack: float = 0.25) -> Column:
    """The power of ten by which a differs from b, if it is near one."""
    log = F.log10(F.abs(a) / F.nullif(F.abs(b), F.lit(0.0)))
    return F.when(F.abs(log - F.round(log)) <= slack, F.round(log).cast("int"))


def split_list(text: Column) -> Column:
    """Items of a delimited list, trimmed, upper-cased, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"[,;|\n]"), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def clauses(text: Column, term: str) -> Column:
    """Sentences that hold ``term``, whatever its case."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), F.lit(term.lower())))


def matches_numeral(text: Column) -> Column:
    """Labels that begin with a Roman numeral and a dot."""
    return text.rlike(r"^[IVXLCDM]+\.")


def missing_body(text: Column, least: int = 30) -> Column:
    """Null, or shorter than ``least`` characters."""
    return F.coalesce(F.length(text), F.lit(0)) < least


def legal_key(name: Column, suffixes: tuple[str, ...] = ("AS", "INC", "LTD", "CO")) -> Column:
    """A name's key: upper case without marks and punctuation, legal suffixes at its end dropped."""
    plain = F.trim(F.regexp_replace(F.upper(fold(name)), r"[^A-Z0-9]+", " "))
    return F.trim(F.regexp_replace(plain, rf"( ({'|'.join(suffixes)}))+$", ""))


def before_keyword(text: Column, keyword: str) -> Column:
    """What stands before a keyword; null without it."""
    got = F.regexp_extract(text, rf"^(.*?)\s*\b{keyword}\b", 1)
    return F.when(text.rlike(rf"\b{keyword}\b"), got)


def short_name(name: Column, words: int = 2) -> Column:
    """The first words of a name."""
    return F.concat_ws(" ", F.slice(F.split(name, r"\s+"), 1, words))


def rate_in(text: Column) -> Column:
    """The first figure before a percent sign or word."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:%|percent)", 1).try_cast("double")


def dates_in(text: Column) -> Column:
    """The first date written as day, month name and year."""
    return F.to_date(F.nullif(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), F.lit("")), "d MMMM yyyy")


def period_date(text: Column) -> Column:
    """A date from dd-MM-yyyy, yyyy-MM-dd, yyyy-M or yyyy-Qn; months and quarters give their first day; others null."""
    quarter = F.concat(F.substring(text, 1, 5), (F.right(text, F.lit(1)).try_cast("int") * 3 - 2).cast("string"))
    forms = ((r"^\d{2}-\d{2}-\d{4}$", text, "dd-MM-yyyy"), (r"^\d{4}-\d{2}-\d{2}$", text, "yyyy-MM-dd"), (r"^\d{4}-\d{1,2}$", text, "yyyy-M"), (r"^\d{4}-Q[1-4]$", quarter, "yyyy-M"))
    return F.coalesce(*(F.try_to_date(F.when(text.rlike(p), t), f) for p, t, f in forms))


#: Letters that are often read in the wrong encoding.
_BROKEN = "çğıöşüÇĞİÖŞÜé"


def misread(text: str) -> str:
    """UTF-8 bytes of a text read as Latin-1."""
    return text.encode().decode("latin-1")


def repair_misread(text: Column, passes: int = 3) -> Column:
    """Letters of a text whose UTF-8 was read as Latin-1, up to ``passes`` times."""
    for _ in range(passes):
        for letter in _BROKEN:
            text = F.replace(text, F.lit(misread(letter)), F.lit(letter))
    return text


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text as hexadecimal."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)), 8, "0"))


def fraction_digits(value: Column, most: int = 6) -> Column:
    """Digits after the point that an amount needs, ``most`` at most."""
    text = F.regexp_replace(F.abs(value).cast(f"decimal(30,{most})").cast("string"), r"\.?0+$", "")
    return F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(F.when(value.isNotNull(), 0))


def misread_separator(value: Column, digits: int = 3, large: float = 1e5) -> Column:
    """A fractional amount with exactly ``digits`` decimals, or with a large integer part: its separator was misread."""
    f = fraction_digits(value)
    return (f == digits) | ((f > 0) & (F.abs(value) >= large))


def signed(value: Column, decimals: int = 1, dash: str = "—") -> Column:
    """A figure with its sign, a dash for none."""
    return F.coalesce(F.concat(F.when(value >= 0, "+").otherwise("-"), F.format_number(F.abs(value), decimals)), F.lit(dash))


def direction(delta: Column, flat: float, strong: float) -> Column:
    """Words for a change by bands of its size; null without one."""
    size = F.abs(delta)
    way = F.when(delta > 0, "up").otherwise("down")
    return F.when(delta.isNull(), None).when(size < flat, "flat").when(size >= strong, F.concat(F.lit("strongly "), way)).otherwise(way)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, and 11th to 13th."""
    last, teens = n % 10, (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def forecast(text: Column) -> Column:
    """The number of a formatted forecast such as ``~ 3.5% (avg)``."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def repair_percent(values: Column, floor: float = 10000.0) -> Column:
    """An array of percentages in which those of ``floor`` or more lost their decimal point."""
    return F.transform(values, lambda x: F.when(F.abs(x) >= floor, x / 100).otherwise(x))


def unit_in(pages: Column, patterns: list[tuple[str, str]], note: str = "restated in") -> Column:
    """The unit that pages name: a transition note's, else the one on all pages, else that of most, else unknown."""
    of = lambda page: F.coalesce(*(F.when(page.rlike(p), name) for name, p in patterns))
    noted = F.filter(F.transform(F.filter(pages, lambda p: F.contains(p, F.lit(note))), of), lambda u: u.isNotNull())
    units = F.filter(F.transform(pages, of), lambda u: u.isNotNull())
    count = lambda name: F.size(F.filter(units, lambda u: u == name))
    most = F.coalesce(*(F.when(2 * count(F.lit(name)) > F.size(units), name) for name, _ in patterns))
    return F.coalesce(F.try_element_at(noted, F.lit(1)), most, F.lit("unknown"))


def pipe_rows(text: Column) -> Column:
    """Rows of cells of the lines that hold pipes; rules of dashes are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[\s|:-]+$"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.transform(lines, cells)


def sql_in(reply: Column) -> Column:
    """The statement in a reply's fenced block, else a bare one; null without any."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:sql)?\s*(.*?)\s*```", 1)
    bare = F.trim(F.regexp_extract(reply, r"(?is)\b((?:select|with)\b[^;`]*)", 1))
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def percents(text: Column) -> Column:
    """Distinct percentages of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)))


def comparisons(text: Column) -> Column:
    """Pairs ``a, way, b`` of comparisons such as ``12.5 above 9``."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)? (?:above|below) \d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.split(x, " ")[0].cast("double").alias("a"), F.split(x, " ")[1].alias("way"), F.split(x, " ")[2].cast("double").alias("b")))


def statement_problem(sql: Column) -> Column:
    """What keeps a text from being one reading statement: several, not a query, or a word that writes; else ok."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"'(?:[^']|'')*'", "''"), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    one = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s*;\s*$", "")
    words = r"(?i)\b(insert|update|delete|drop|alter|create|attach|pragma|replace|truncate)\b"
    return F.when(F.contains(one, F.lit(";")), "several").when(~one.rlike(r"(?i)^(with|select)\b"), "not a query").when(one.rlike(words), "word").otherwise("ok")
