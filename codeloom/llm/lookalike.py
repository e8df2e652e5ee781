"""One consistent form for text that looks the same.

Per token the sets of scripts in which each character can be spelled are intersected. Look-alike letters first become
Latin; if the intersection lacks Latin but has one script, the token is spelled in that script again (`работа` with a
Latin `a` becomes all Cyrillic); an empty intersection is a mixed token and keeps its folded letters; a token that
Latin and another script can spell (whole-script confusable) is spelled in Latin, one that several others but not Latin
can spell in the first of them, Cyrillic before Greek. The remaining forms are normalised:
full-width and half-width forms, ligatures and other compatibility forms, composed accents (NFC), the no-break and other
single spaces, hyphens, and default-ignorable characters, which are dropped (a joiner between two pictographs stays).
Raised and lowered digits, circled and styled letters differ to the eye and stay.

Look-alikes come from the confusables data of the ICU library that Spark ships: letters of another alphabet
whose skeleton is that of an ASCII letter of the same case (or, without case, of a letter in one case only), letters with case of two other scripts that share any other skeleton
(Cyrillic and Greek `п` and `π`; they become the one of the least code point until the token's script is known), and
marks of another script with the skeleton of an ASCII mark. The table is built on the driver and sent with the task.

Defined results: null stays null and is in no pair; texts without a visible character are in no pair; equal texts are no
pair but members of one class; very long texts are handled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compatibility forms that look like what they decompose to.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Compatibility forms that nevertheless look different: the long s.
_DIFFERENT = {"\u017f", "\u1e9b"}
#: Hyphens of the width of the ASCII one.
_HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"

#: The scripts that come first where several can spell a token.
_ORDER = {"CYRILLIC": 0, "GREEK": 1}
#: Letters that have look-alikes in no alphabet, only among themselves.
_NO_ALPHABET = r"\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Bopomofo}"
_PICTURE_JOINER = regex.compile(r"(?<=\p{Extended_Pictographic}[\ufe0f\U0001f3fb-\U0001f3ff]?)\u200d(?=\p{Extended_Pictographic})")
_KEPT_JOINER = "\ufdd0"  # stands for such a joiner meanwhile
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}|[\x00-\x08\x0e-\x1f\x7f]")
_VISIBLE = regex.compile(r"[^\p{Z}\p{C}\p{Default_Ignorable_Code_Point}\s\u2800]")
_SEPARATOR = "\ue000"
#: Where compatibility forms, spaces and default-ignorable characters lie: the first two planes and plane 14.
_FORMS = [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000)]


@lru_cache(1 << 16)
def script_of(ch: str) -> str:
    """The script of a letter, by the first word of its name."""
    return unicodedata.name(ch, "?").split()[0]


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Character of another script -> ASCII character of the same look and case, from ICU's confusables, else the least letter of the other scripts that share it."""
    icu = spark._jvm.com.ibm.icu.text
    checker = getattr(icu, "SpoofChecker$Builder")().build()
    chars = [chr(i) for i in range(0x21, 0x20000) if not 0xD800 <= i < 0xF900 and unicodedata.category(chr(i))[0] in "LPS" and (i < 0x7F or not regex.match(rf"[\p{{Common}}\p{{Inherited}}\p{{Latin}}{_NO_ALPHABET}]", chr(i)))]
    skeletons = checker.getSkeleton(_SEPARATOR.join(chars)).split(_SEPARATOR)
    if len(skeletons) != len(chars):
        raise RuntimeError("the confusables data can't be read")
    kind = lambda ch: c if (c := unicodedata.category(ch)) in ("Lu", "Ll") else c[0]
    ascii_of = {(s, kind(c)): c for c, s in reversed(list(zip(chars, skeletons, strict=True))) if c < "\x7f" and kind(c) in ("Lu", "Ll", "P", "S")}
    found = {}
    for c, s in zip(chars, skeletons, strict=True):
        if c > "\x7f" and kind(c) in ("Lu", "Ll", "P", "S") and (to := ascii_of.get((s, kind(c)))):
            found[c] = to
        elif unicodedata.category(c) == "Lo":  # of a script without case: like one that looks so in either case, if it is clear in which
            cases = [ascii_of[s, k] for k in ("Lu", "Ll") if (s, k) in ascii_of]
            if len(cases) == 1 or cases and script_of(c) == "LISU":  # whose letters are shaped like capitals
                found[c] = cases[0]
    groups: dict[tuple[str, str], list[str]] = {}
    for c, s in zip(chars, skeletons, strict=True):
        if kind(c) in ("Lu", "Ll") and script_of(c) and (s, kind(c)) not in ascii_of and unicodedata.is_normalized("NFD", c):
            groups.setdefault((s, kind(c)), []).append(c)
    for group in groups.values():
        if len({script_of(c) for c in group}) > 1:
            found |= dict.fromkeys(group, min(group))
    return found


class Normalizer:
    """Texts to their consistent form, for a table of look-alikes."""

    def __init__(self, table: dict[str, str]) -> None:
        fold: dict[int, str | None] = {}
        ignorable = set(regex.findall(r"\p{Default_Ignorable_Code_Point}", "".join(map(chr, _FORMS))))
        for i in _FORMS:
            ch = chr(i)
            how = unicodedata.decomposition(ch).partition(" ")[0]
            if ch in _HYPHENS:
                fold[i] = "-"
            elif unicodedata.category(ch) == "Zs":
                fold[i] = " "
            elif how in _SAME_LOOK and ch not in _DIFFERENT:
                fold[i] = unicodedata.normalize("NFD", unicodedata.normalize("NFKD", ch)).translate({ord(a): b for a, b in table.items()})
            elif how and not how.startswith("<"):
                continue
            elif ch in ignorable:
                fold[i] = None
        fold |= {ord(a): b for a, b in table.items()}
        fold |= {i: None for i in [*range(9), *range(0x0E, 0x20), 0x7F]}
        self.fold = fold
        self.respell: dict[str, dict[str, str]] = {}
        for ch, to in sorted(table.items(), reverse=True):
            if (s := script_of(ch)) != "LATIN" and ch.isalpha():
                self.respell.setdefault(s, {})[to] = ch
        self.scripts = {c: frozenset({"LATIN"} | {s for s, m in self.respell.items() if c in m}) for c in map(chr, range(0x41, 0x7B)) if c.isalpha()}
        self.scripts |= {c: frozenset(s for s, m in self.respell.items() if c in m) for c in set(table.values()) if not c.isascii()}
        other = rf"[\p{{L}}--[\p{{Latin}}\p{{Common}}{_NO_ALPHABET}]]"
        # from a word's start and without going back, so that words of any length take time in proportion
        self.other = regex.compile(rf"(?V1)(?<![\p{{L}}\p{{M}}])[[\p{{L}}\p{{M}}]--{other}]*+{other}[\p{{L}}\p{{M}}]*+")

    def token(self, word: str) -> str:
        """A folded token, spelled in the one script that has all its letters."""
        common: frozenset[str] | None = None
        parts = unicodedata.normalize("NFD", word)
        for ch in parts:
            if ch.isalpha():
                own = self.scripts.get(ch) or frozenset({script_of(ch)})
                common = own if common is None else common & own
        if not common or "LATIN" in common:
            return word
        return unicodedata.normalize("NFC", parts.translate(str.maketrans(self.respell.get(min(common, key=lambda s: (_ORDER.get(s, 9), s)), {}))))

    def text(self, s: str) -> str:
        if s.isascii():
            return _IGNORABLE.sub("", s)
        if "\u200d" in s:
            s = _PICTURE_JOINER.sub(_KEPT_JOINER, s)
        s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(self.fold))
        s = self.other.sub(lambda m: self.token(m[0]), s)
        return s.replace(_KEPT_JOINER, "\u200d")


@lru_cache(2)
def _normalizer(table: tuple[tuple[str, str], ...]) -> Normalizer:
    return Normalizer(dict(table))


def normalized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text` with each text in its consistent form."""
    table = tuple(sorted(lookalikes(docs.sparkSession).items()))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = _normalizer(table).text
        for b in batches:
            b["text"] = [None if t is None else form(t) for t in b["text"]]
            yield b

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {id_type}, text string")


def looks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text_hash, look_hash` (128 bits each) of the texts with a visible character; the texts stay behind."""
    table = tuple(sorted(lookalikes(docs.sparkSession).items()))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, digest = _normalizer(table).text, xxhash.xxh3_128_digest
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                if t is not None and _VISIBLE.search(t):
                    own = digest(t.encode())
                    look = form(t)
                    rows.append((i, own, own if look == t else digest(look.encode())))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "look_hash"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {id_type}, text_hash binary, look_hash binary")


def look_classes(hashes: DataFrame) -> DataFrame:
    """`look_hash, text_hash, rep, copies` of the different texts of each look that has several; rep: the least doc_id."""
    texts = hashes.groupBy("look_hash", "text_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    several = texts.groupBy("look_hash").agg(F.count("*").alias("n")).where("n > 1").select("look_hash")
    return texts.join(several, "look_hash", "left_semi")


def lookalike_pairs(hashes: DataFrame) -> DataFrame:
    """`doc_id_a, doc_id_b`, the smaller first: each document with the representative of each other text of its look.

    Copies aren't expanded on both sides, so a text with many copies makes rows in proportion to the copies.
    """
    texts = look_classes(hashes)
    reps = texts.select("look_hash", F.col("text_hash").alias("other"), "rep")
    members = hashes.join(texts.select("text_hash"), "text_hash", "left_semi")
    pairs = members.join(reps, (members.look_hash == reps.look_hash) & (members.text_hash != reps.other))
    return pairs.select(F.least("doc_id", "rep").alias("doc_id_a"), F.greatest("doc_id", "rep").alias("doc_id_b")).distinct()
