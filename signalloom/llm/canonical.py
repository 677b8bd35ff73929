"""Problem 3: text that looks the same brought to one form, and values whose characters differ from it."""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import per_batch

#: Characters of distinct values, and of their results, that a task keeps.
KEPT_CHARS = 16 << 20

#: Fixed value: letters of other scripts that look like Latin ones, for words that otherwise are Latin.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁԛԝһӏкмнтвгпиг" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυχτηεγ" "օսոցհԼԱՏ",
    "ABESIJKMHOPCTYX3aesijopcyxdqwhlkmhtbrnur" "ABEZHIKMNOPTYXoavikpuxtney" "ouoghLUS",
))

#: Fixed value: the same of the other alphabets that _other_script has.  Their letters that look like no Latin one stay.
MORE_LOOKALIKES = dict(zip(
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ" "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲏⲓⲕⲙⲛⲟⲣⲥⲧⲩⲭ" "ყჿ" "סוןهاⵔⵝⴹ",
    "BPDTGKJCZFMNLSRVHWXYAEIOU" "DRTAJEWMHGZRVSLCPKB" "HIKMNOPCTYXhikmnopctyx" "yo" "ollolOXE",
))
# case folding makes small Cherokee letters capital
MORE_LOOKALIKES |= {chr(ord(c) - 0x13A0 + 0xAB70): x for c, x in MORE_LOOKALIKES.items() if "Ꭰ" <= c <= "Ꮿ"} | {"ᏼ": "B"}

_fullwidth = re.compile(r"[！-～]")
_space = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\x85--[ ]]", regex.V1)
_cluster = regex.compile(r"\P{M}\p{M}+")
_ignorable = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}--[؀-؅۝܏࣢\U000110bd\U000110cd]]", regex.V1)
_emoji = r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}#*0-9⃣\U0001f3f4]"
#: Joiners, presentation selectors and tags where they belong to an emoji.
_in_emoji = regex.compile(rf"(?<={_emoji}️?)‍(?={_emoji})|(?<={_emoji})[︎️]|(?<=\U0001f3f4[\U000e0020-\U000e007e]*)[\U000e0020-\U000e007f]")
_other_script = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Lisu}\p{Georgian}\p{Hebrew}\p{Arabic}\p{Tifinagh}]")
_word = regex.compile(r"[\p{L}\p{M}]+")
_latin = regex.compile(r"\p{Latin}")
_not_ascii_letter = regex.compile(r"[^\x00-\x7f\p{Latin}]")
_text_mark = regex.compile(r"\p{M}")


def _mixed_words(text: str) -> list[tuple[int, int]]:
    """Where words stand that hold Latin letters and letters of another alphabet."""
    if not _other_script.search(text):
        return []
    return [m.span() for m in _word.finditer(text) if _other_script.search(m.group()) and _latin.search(m.group())]


def _strip(text: str) -> str:
    """Without default-ignorable characters, but for those that belong to an emoji."""
    if not _ignorable.search(text):
        return text
    return _ignorable.sub(lambda m: m.group() if _in_emoji.match(text, m.start()) else "", text)


def _spaces(text: str) -> str:
    return _space.sub(" ", text)


def _widths(text: str) -> str:
    """Full-width ASCII forms as ASCII."""
    return _fullwidth.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)


def _composed(text: str) -> str:
    """A base and marks that have a shorter composed form in that form."""
    if not _text_mark.search(text):
        return text
    return _cluster.sub(lambda m: c if len(c := unicodedata.normalize("NFC", m.group())) < len(m.group()) else m.group(), text)


def _latin_words(text: str) -> str:
    """Letters of other alphabets that look like a Latin one replaced by it, in words that hold a Latin letter."""
    for a, b in reversed(_mixed_words(text)):
        text = text[:a] + "".join(LOOKALIKES.get(c) or MORE_LOOKALIKES.get(c, c) for c in text[a:b]) + text[b:]
    return text


#: The steps whose changes the eye doesn't see, in order.
UNSEEN = (_strip, _spaces, _widths, _composed, _latin_words)
#: No text is known to take more than four rounds.
ROUNDS = 24


def unseen(text: str) -> str:
    """The text after one round of the unseen steps."""
    for step in UNSEEN:
        text = step(text)
    return text


def deviates(text: str | None) -> bool:
    """True where an unseen step of canonical() changes the text: it holds a full-width ASCII form, a base and
    combining mark that have a composed form, an invisible character other than an emoji's or a space other than
    ASCII's, or a Latin word has a letter of another alphabet (also one that looks like no Latin letter)."""
    if not text or text.isascii():
        return False
    return unseen(text) != text or bool(_mixed_words(text))


def canonical(text: str | None) -> str | None:
    """The one form: the unseen steps (default-ignorable characters removed but in emoji, spaces, widths, composed
    marks, look-alike letters of Latin words), compatibility normalisation composed (NFKC), full case folding, and
    every run of white space a single space, none at the ends.

    All steps are repeated until none changes anything, as folding may make a letter that has a look-alike and
    replacing one a word that folds, so the form is stable: applied again it changes nothing."""
    if not text:
        return text
    if text.isascii():
        return " ".join(text.lower().split())
    for _ in range(ROUNDS):
        after = " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", unseen(text)).casefold()).split())
        if after == text:
            break
        text = after
    return text


def _quotes(value: str | None) -> list | None:
    """The decoded JSON list, or None."""
    if not value:
        return None
    try:
        found = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, list) else None


def deviates_json(value: str | None) -> bool:
    """True where a decoded quote deviates."""
    if not value or value.isascii() and "\\u" not in value:
        return False
    return any(isinstance(q, str) and deviates(q) for q in _quotes(value) or ())


def canonical_json(value: str | None) -> str | None:
    """The list with every quote in the one form; a malformed or other value stays as it is."""
    if (found := _quotes(value)) is None:
        return value
    return json.dumps([canonical(q) if isinstance(q, str) else q for q in found], ensure_ascii=False)


class _Kept(dict):
    """Results of distinct values, dropped when their characters pass a bound; `f` makes what is missing."""

    def __init__(self, f):
        super().__init__()
        self.f, self.chars = f, 0

    def __missing__(self, value):
        result = self.f(value)
        size = len(value or "") + (len(result) if isinstance(result, str) else 1)
        if self.chars + size > KEPT_CHARS:
            self.clear()
            self.chars = 0
        if size <= KEPT_CHARS:
            self[value] = result
            self.chars += size
        return result


def _per_distinct(column: pa.Array, kept: _Kept, kind: pa.DataType) -> pa.Array:
    """The results of every distinct value of the column, spread over its rows again."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    return pa.array([kept[value] for value in coded.dictionary.to_pylist()], kind).take(coded.indices)


def _narrow(df: DataFrame, id_col: str, text_col: str, json_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(json_col).cast("string").alias("j"))


def canonical_rows(df: DataFrame, id_col: str = "id", text_col: str = "body", json_col: str = "evidence_spans_json") -> DataFrame:
    """(id, text_col, json_col): the same rows, both fields in the one form, each distinct value taken once a batch.

    Null stays null, empty stays empty, malformed JSON stays as it is; repeated rows and null ids are kept; an
    empty table gives an empty result; other columns aren't read.  Nothing is shuffled."""

    def make():
        texts, lists = _Kept(canonical), _Kept(canonical_json)

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("id"), _per_distinct(batch.column("t"), texts, pa.string()), _per_distinct(batch.column("j"), lists, pa.string())], ["id", text_col, json_col])

        return handle

    return per_batch(_narrow(df, id_col, text_col, json_col), make, f"id long, `{text_col}` string, `{json_col}` string")


def deviating_values(df: DataFrame, id_col: str = "id", text_col: str = "body", json_col: str = "evidence_spans_json") -> DataFrame:
    """(id, field_name) of every value whose characters deviate from the one form in a way that can't be seen.

    Null, empty, blank and malformed values are none; repeated rows are each reported; an empty table gives an
    empty result; other columns aren't read.  Nothing is shuffled."""

    def make():
        texts, lists = _Kept(deviates), _Kept(deviates_json)

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, names = [], []
            for column, name, kept in (("t", text_col, texts), ("j", json_col, lists)):
                if batch.num_rows:
                    own = batch.column("id").filter(_per_distinct(batch.column(column), kept, pa.bool_()))
                    ids.append(own)
                    names += [name] * len(own)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids) if ids else pa.array([], pa.int64()), pa.array(names, pa.string())], ["id", "field_name"])

        return handle

    # a value can deviate only if it isn't ASCII, or if JSON escapes hide that it isn't
    narrow = _narrow(df, id_col, text_col, json_col)
    odd = narrow.withColumns({"t": F.when(F.col("t").rlike(r"[^\x00-\x7f]"), F.col("t")), "j": F.when(F.col("j").rlike(r"[^\x00-\x7f]|\\u"), F.col("j"))})
    return per_batch(odd.where("t is not null or j is not null"), make, "id long, field_name string")
