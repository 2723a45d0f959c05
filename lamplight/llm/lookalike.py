"""One consistent form for texts that look the same but differ in characters.

Per letter a resolved script set says in which of Latin, Cyrillic and Greek the same shape
can be written. The sets of a token are intersected: one script left is the consistent
spelling (mixed-script confusables fall to it), several left is a whole-script confusable
and takes the script of the nearest token before it that leaves no choice. Everything
depends on shapes alone, so texts of equal shape get equal forms. Other forms (full width,
decomposed accents, invisible characters, spaces, ligatures, hyphens) are normalized first.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.session import cut

# Letters of one shape, as Latin Cyrillic Greek; - where a script has none.
SHAPES = """
a а α
c с ϲ
d ԁ -
e е -
g - -
h һ -
i і ι
j ј ϳ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
u - υ
v ѵ ν
w ԝ -
x х -
y у -
A А Α
B В Β
C С Ϲ
E Е Ε
G Ԍ -
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
- Г Γ
- П Π
- Ф Φ
- Ѱ Ψ
- Ѳ Θ
- к κ
- т τ
- ф φ
- ѱ ψ
- є ε
"""
# Other ways to write one of the letters above, or another letter.
SAME = {"У": "Ү", "ү": "у", "Ӏ": "І", "ɑ": "a", "ɡ": "g", "ı": "i", "µ": "μ"}
#: Characters without a mark of their own.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
#: Spaces about as wide as a space, and hyphens as short as a hyphen.
SPACES = "\u00a0\u2000\u2002\u2004\u2005\u2006\u2007\u2008\u2009\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: Rows without one of these characters are in their form already.
TOUCHED = (
    r"[\u00a0\u00ad\u00b5\u0131\u0251\u0261\u0300-\u052f\u061c\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u1f00-\u1fff\u2000-\u2011"
    r"\u2028-\u202f\u205f-\u2064\u20d0-\u20ff\u212a\u212b\u2126\u3000-\u30ff\u1100-\u11ff\uac00-\ud7a3\uf900-\ufb4f\ufe00-\ufe0f\ufe63\ufeff\uff01-\uff5e]"
)

SCRIPTS = "LCG"
_TABLE: dict[int, str | None] = {
    **{ord(c): None for c in INVISIBLE},
    **{ord(c): " " for c in SPACES},
    **{c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)},
    **{ord(c): "-" for c in HYPHENS},
    **{ord(c): x for c, x in LIGATURES.items()},
}
_SHAPES = [row.split() for row in SHAPES.split("\n") if row]
#: Letter to its row; and a row's letter in each script.
_ROW = {c: row for row in _SHAPES for c in row if c != "-"}
_FOREIGN = re.compile("[\u0370-\u052f\u1f00-\u1fff]").search
_FROM_SAME = str.maketrans(SAME)
_JOINED = re.compile("(?<=[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")
#: A token: letters with their marks.
_TOKENS = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")


def _own(c: str) -> str:
    return "G" if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" else "C" if "\u0400" <= c <= "\u052f" else "L"


def _resolve(token: str, known: dict[str, tuple[str, dict[str, str]]]) -> tuple[str, dict[str, str]]:
    """Scripts the whole token can be written in, and its spelling in each of L, C and G."""
    if (found := known.get(token)) is None:
        sets, spelt = [], {s: [] for s in SCRIPTS}
        for c in token:
            if "\u0300" <= c <= "\u036f":
                for s in SCRIPTS:
                    spelt[s].append(c)
                continue
            row = _ROW.get(c)
            sets.append({s for s, x in zip(SCRIPTS, row, strict=True) if x != "-"} if row else {_own(c)})
            for s, x in zip(SCRIPTS, row or (c, c, c), strict=True):
                spelt[s].append(x if x != "-" else next(y for y in row if y != "-"))
        common = set.intersection(*sets)
        if not common:  # no consistent spelling: the script that can write most letters
            common = {max(SCRIPTS, key=lambda s: (sum(s in x for x in sets), -SCRIPTS.index(s)))}
        if len(known) > 300_000:
            known.clear()
        known[token] = found = ("".join(s for s in SCRIPTS if s in common), {s: "".join(x) for s, x in spelt.items()})
    return found


def canonical(text: str | None, known: dict | None = None) -> str | None:
    """The consistent form of a text; null stays null."""
    if text is None or text.isascii():
        return text
    known = {} if known is None else known
    parts = _JOINED.split(text) if "\u200d" in text else [text]
    text = "\u200d".join(p.translate(_TABLE) for p in parts).translate(_FROM_SAME)
    if not _FOREIGN(text):
        return unicodedata.normalize("NFC", text)
    text = unicodedata.normalize("NFD", text)
    places = [(m.start(), m.end(), *_resolve(m.group(), known)) for m in _TOKENS.finditer(text)]
    script = next((s for _, _, s, _ in places if len(s) == 1), "L")
    out, at = [], 0
    for start, end, scripts, spelt in places:
        if len(scripts) == 1:
            script = scripts
        out += (text[at:start], spelt[script if script in scripts else scripts[0]])
        at = end
    out.append(text[at:])
    return unicodedata.normalize("NFC", "".join(out))


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with the consistent form of column text; null stays null, an existing out is replaced.

    Only rows with a character that can change visit Python, as one narrow column.
    """
    kept = [c for c in df.columns if c != out]
    known: dict = {}

    @F.pandas_udf("string")
    def form(texts):
        return texts.map(lambda t: canonical(t, known))

    t: Column = F.when(df[text].rlike(TOUCHED), df[text])
    return df.withColumn("__touched", t).withColumn(out, F.coalesce(form("__touched"), F.col(text))).select(*kept, out)


def forms_of(rows: DataFrame) -> DataFrame:
    """(tbl, id, form key, text key) of rows (tbl, id, text): 128-bit keys."""
    made = with_form(rows.filter(F.col("text").isNotNull()), "text", "form_text")
    key = lambda c: F.unhex(F.md5(c))
    return made.select("tbl", "id", key("form_text").alias("form"), key("text").alias("variant"))


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (tbl, id_a, id_b; a < b) of rows (tbl, id, text) of equal form and unequal text.

    Null texts pair with nothing; repeated rows count once; rows of equal text never pair, and
    are never compared: forms with a single text leave after a partial aggregation, and pairs
    are made between the distinct texts of a form before their rows are joined on.
    """
    keys = cut(forms_of(rows))  # a few bytes a row, read several times
    several = keys.groupBy("tbl", "form").agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).filter("lo != hi").select("tbl", "form")
    members = keys.join(several, ["tbl", "form"], "left_semi").distinct()
    texts = members.select("tbl", "form", "variant").distinct()
    a, b = texts.withColumnRenamed("variant", "va"), texts.withColumnRenamed("variant", "vb")
    pairs = a.join(b, ["tbl", "form"]).filter("va < vb")
    left = members.select("tbl", "form", F.col("variant").alias("va"), F.col("id").alias("x"))
    right = members.select("tbl", "form", F.col("variant").alias("vb"), F.col("id").alias("y"))
    joined = pairs.join(left, ["tbl", "form", "va"]).join(right, ["tbl", "form", "vb"]).filter("x != y")
    return joined.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """(tbl, id, class_id, links) of every row (tbl, id, text) that looks like one of another text.

    A class is the rows of one form, named by its lowest id; links is with how many of them a row pairs:
    those of unequal text. A group of copies costs its rows, not their pairs. Null texts are in no class;
    repeated rows count once. Rows are counted by text before they are by form, and a hot text is joined
    with its one count.
    """
    keys = cut(forms_of(rows).distinct())
    texts = keys.groupBy("tbl", "form", "variant").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    forms = texts.groupBy("tbl", "form").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"), F.count("*").alias("texts")).filter("texts > 1").select("tbl", "form", "all", "class_id")
    counts = texts.join(forms, ["tbl", "form"]).select("tbl", "form", "variant", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return keys.join(counts, ["tbl", "form", "variant"]).select("tbl", "id", "class_id", "links")
