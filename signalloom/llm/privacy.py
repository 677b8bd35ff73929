"""Problem 4: personal information in free text, found behind disguises and replaced by typed placeholders."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, per_batch
from .canonical import LOOKALIKES
from .names import AROUND, ALIKE, BITS, COMMON, FEWEST, LEAST, TEXTS, NameModel, common_features, fit, in_lower_case, number, plain_features, slopes, uses, words

#: The kinds, in order of precedence, and what stands in their place.
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

#: Given names that make two capitalised words a person.  Others are told by title, initial or what stands around them.
GIVEN_NAMES = frozenset("""
Aaron Adam Agnes Ahmed Aisha Alan Alejandro Alice Amara Amina Amy Ana Andrea Andrew Angela Anna Anne Anselm Anthony Antonio Aoife Arjun
Barbara Ben Benjamin Bogdan Brian Bruno Carlos Carmen Caroline Catherine Charles Charlotte Chen Chloe Christine Ciaran Claire Clara Daniel Darius
David Deborah Delphine Dmitri Edward Elena Elizabeth Elowen Emily Emma Eric Erik Eva Farida Fatima Felix Fiona Francesca Francisco Frank Gabriel
George Grace Hannah Hans Hassan Helen Henry Hiroshi Hollis Hugo Ian Imke Ines Ingrid Isabel Ivan Jack James Jan Jane Janet Jason Javier Jean
Jennifer Jessica Joan John Jonathan Jorge Jorvik Jose Joseph Juan Julia Karen Karl Kate Kenji Kevin Kofi Laura Lena Leonie Lina Linda Lisa Lucas
Lucia Lucinda Luis Maria Marie Mario Mark Marta Martin Mary Matteo Matthew Mei Michael Miguel Mireille Mohammed Nadia Nicole Noah Noor Nora Olga
Oliver Olivia Omar Oskar Pablo Patricia Paul Pavel Pedro Peter Philip Priska Priya Rachel Raj Rebecca Richard Robert Ruben Ruth Samuel Sandra
Sara Sarah Sofia Sophie Stefan Stephen Susan Svenja Tadeo Talia Thomas Tim Wei William Xavier Yuki Yusra Zofia
""".split())

#: Words that make a capitalised pair an organisation, product or place, or begin a sentence.
NOT_NAMES = frozenset("""
Systems System Inc Ltd Llc Gmbh Corp Company Group Labs Lab Software Ledger Terminal Team Street Road Avenue Lane Court Bank Services Service
Solutions Technologies Cloud Suite Desk Support Office Branch Harbor Airport University Hospital School North South East West New Old Saint
The This That We It They You He She I If In On At For To When What Why How Is Are Do Does Not No Yes Please Thanks And But So Our My Your
Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December
After Before Since Because Between Every Nobody Last Has Have Right Until During Ever Over Honestly Switching Edit Does Best Dear Hi Hello
""".split())

#: Of each part of a changed text: its place and length here, and those in the text that it comes from.
Origin = list[tuple[int, int, int, int]]

_digit_word = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_spelled = re.compile(rf"\b(?:{'|'.join(_digit_word)})(?:[\s,.-]+(?:{'|'.join(_digit_word)})){{5,}}\b", re.I)
_two_spelled = re.compile(rf"(?:{'|'.join(_digit_word)})[\s,.-]+(?:{'|'.join(_digit_word)})\b")
_letters = re.compile(r"[A-Za-z]+")
#: (at), [dot] and the like with the blanks around them; bare words only where both stand in one address.
_bracketed = re.compile(r"\s*[\[({<]\s*(at|dot)\s*[\])}>]\s*", re.I)
_bare_address = re.compile(r"\b([\w.+-]+)( at )([\w-]+)((?: dot [\w-]+)+)\b", re.I)
_bare_dot = re.compile(r" dot ", re.I)
_letter_run = re.compile(r"[^\W\d_]+")
_entity = re.compile(r"&#(?:64|x40);|&commat;", re.I)
_invisible = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_mixed = regex.compile(r"\p{Latin}[\p{L}\p{M}]*[\p{Cyrillic}\p{Greek}\p{Armenian}]|[\p{Cyrillic}\p{Greek}\p{Armenian}][\p{L}\p{M}]*\p{Latin}")
_blank = regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
_compat = re.compile(r"[！-～０-９]")

_email = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+'-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_numbers = re.compile(r"\d[\d ().\-/]{4,}\d|[A-Z]\d{3}-|[A-Z]{1,2} ?\d\d ?\d\d")
_phones = [re.compile(p) for p in (
    r"(?<![\w+])\+(?:\d{10,15}|\d{1,3}(?:[ .\-/]?\(?\d+\)?){1,6})(?![\w-]|[.,]\d)",
    r"(?<![\w.,/+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|[.,]\d)",
    r"(?<![\w.,/+-])0\d(?:[ .]\d\d){4}(?![\w-]|[.,]\d)",
    r"(?<![\w.,/+-])\(?0\d{2,4}\)?(?:[ /]| - ?|-)\d{3,8}(?:[ -]\d{2,5})?(?![\w-]|[.,]\d)",
    r"(?i)(?<=\b(?:call|text) )\d{7,11}(?!\w)|(?<=\btel[.:] )\d{7,11}(?!\w)|(?<=\bphone[: ] )\d{7,11}(?!\w)",
)]
_ids = [re.compile(p) for p in (
    r"(?i)\b(?:ssn|social security (?:number|no\.?|nr\.?))(?:[\s:#]|\bis\b)*(?P<n>\d{3}[ .-]?\d{2}[ .-]?\d{4})(?![\w-])",
    r"(?<![\w-])(?P<n>\d{3}-\d{2}-\d{4})(?![\w-])",
    r"(?<![\w-])(?P<n>[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d])(?![\w-])",
    r"(?i)\bpassport(?:\s*(?:number|no\.?|nr\.?|#))?(?:[\s:#]|\bis\b)*(?P<n>[A-Z]{0,2}\d{6,9})(?![\w-])",
    r"(?i)\b(?:driver'?s?|driving|driver’s)[ -]licen[cs]e(?:\s*(?:number|no\.?|nr\.?|#))?(?:[\s:#]|\bis\b)*(?P<n>[A-Z0-9]+(?:[- ]?\d{2,}){1,4})(?![\w-])",
    r"(?<![\w-])(?P<n>[A-Z]\d{3}-\d{4}-\d{4})(?![\w-])",
)]
_cap = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_suffix = r"(?i:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way|place|pl|square|sq|terrace|ter|parkway|pkwy|highway|hwy|circle|cir|close|crescent|mews)"
_addresses = [re.compile(p) for p in (
    rf"(?<![\w.,$€£-])\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:{_cap} ){{1,4}}{_suffix}\b(?! [A-ZÀ-Þ](?!\w*\b,))\.?(?:,? (?:Apt|Suite|Unit|#)\.? ?\w+)?(?:,[ \n]{_cap}|\n{_cap}(?=, [A-Z]{{2}} \d))?(?:, [A-Z]{{2}} \d{{5}})?",
    r"\b[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|allee|weg|platz|ring|damm|ufer) \d{1,4}[a-z]?(?:, \d{5} [A-ZÄÖÜ]\w+)?\b",
    rf"(?<![\w.,$€£-])\d{{1,4}}(?: bis| ter)?,? (?i:rue|boulevard|chemin|allée|impasse|quai|avenue|place) (?:(?:des|du|de|la|les|le) |[ld]['’]|{_cap} ?)+(?:, {_cap})?",
    rf"\b(?:Calle|Avenida|Av\.|Paseo|Camino|Plaza|Via|Viale|Corso|Piazza|Rua) (?:(?:de|del|della|di|do|da|la|las|los|el|{_cap}) )+\d{{1,4}}(?:, {_cap})?",
    rf"\b(?i:p\.? ?o\.? box|postfach) \d+(?:, {_cap})?",
)]
#: What a text in lower case must hold for each of these to be looked for.
_address_hints = (None, ("straße", "strasse", "str.", "gasse", "allee", "weg ", "platz", "ring ", "damm ", "ufer "), ("rue ", "boulevard ", "chemin ", "allée ", "impasse ", "quai ", "avenue ", "place "), ("calle ", "avenida ", "av. ", "paseo ", "camino ", "plaza ", "via ", "viale ", "corso ", "piazza ", "rua "), ("box ", "postfach "))
_run = re.compile(r"(?<!\d)\d{7,15}(?!\d)")
_digit = re.compile(r"\d")
_number_word = re.compile(r"\d[A-Za-z]?,? [A-ZÀ-Þ]")
_id_hint = re.compile(r"\d{3}-\d\d-|\d{6}|\d\d ?\d\d ?\d\d ?[A-Da-d]\b|\d{3}-\d{4}|\d[ .-]\d\d[ .-]\d")
_titled = re.compile(rf"\b(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof|Herr|Frau|Mme|Sra|Sr|DR|MR|MRS|MS|PROF)\b\.?\s+(?P<n>(?:[A-Z]\.\s*)?{_cap}(?: (?:van |von |de |la |del )?{_cap})?)")
_initialled = re.compile(rf"(?<![\w.&'’])[A-Z]\. ?(?:[A-Z]\. ?)?(?P<n>[A-Z][a-zà-ÿ'’-]{{2,}})\b")
_pair = re.compile(rf"(?<![\w'’-])({_cap})(?= (?:[A-Z]\. )?(?:(?:van|von|de|la|del|der) )*({_cap}))")
_cue_before = re.compile(r"(?i)(?:\b(?:signed|sincerely|according to|my name is|name|one by|colleague|assistant|bookkeeper|accountant|manager|boss|teammate|ask for|contact|reads)[,:]?|\bbest,|\bregards,)\s$")
_cue_after = re.compile(r" (?:keeps telling|told me|said that|asked me|wrote me|emailed|called me)\b|['’]s (?:order|desk|account|invoice|email)\b")
_named = GIVEN_NAMES | {x.upper() for x in GIVEN_NAMES}
_not_named = NOT_NAMES | {x.upper() for x in NOT_NAMES}
_author = re.compile(rf"(?:(?:Dr|Mr|Mrs|Ms|Prof)\.? )?(?:{_cap}(?: [A-Z]\.)?(?: (?:van|von|de|la|del|der))* {_cap}|[A-Z]\. ?{_cap}|{_cap}, {_cap})(?: \([^()]*\))?")


def _plain_name(word: str) -> str:
    return word.capitalize() if word.isupper() else word


def _could_be(a: str, b: str) -> bool:
    """Neither of two capitalised words speaks against a name."""
    return not (len(a) > 1 and a in _not_named or b in _not_named or b.isupper() and len(b) < 3)


def normalised(text: str) -> tuple[str, list[Origin]]:
    """The text without disguises, and where its parts come from.

    Transducers replace look-alike and full-width characters and drop invisible ones; a second pass joins spelled
    digits and puts @ and . for their words.  The second value has the origin of each pass that changed something,
    the last pass first; _span goes back through them one by one."""
    edits: list[tuple[int, int, str]] = []
    origins = []
    step = text
    if not text.isascii():
        alike = [m.span() for m in _mixed.finditer(text)]
        spans = [(m.start(), m.end()) for a, _ in alike if (m := _letter_run.match(text, _word_start(text, a)))]
        for a, b in spans:
            edits += [(i, i + 1, LOOKALIKES[text[i]]) for i in range(a, b) if text[i] in LOOKALIKES]
        edits += [(m.start(), m.end(), "") for m in _invisible.finditer(text)]
        edits += [(m.start(), m.end(), " ") for m in _blank.finditer(text)]
        edits += [(m.start(), m.end(), unicodedata.normalize("NFKC", m.group())) for m in _compat.finditer(text)]
        if edits:
            step, origin = _apply(text, edits)
            origins.append(origin)
    edits = []
    low = step.lower()
    if ("(" in low or "[" in low or "{" in low or "<" in low) and _bracketed.search(step):
        edits += [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _bracketed.finditer(step)]
    if " at " in low and " dot " in low:
        for m in _bare_address.finditer(step):
            edits.append((m.start(2), m.end(2), "@"))
            edits += [(m.start(4) + d.start(), m.start(4) + d.end(), ".") for d in _bare_dot.finditer(m[4])]
    if "&" in low:
        edits += [(m.start(), m.end(), "@") for m in _entity.finditer(step)]
    if _spelled_hint(low):
        edits += [(m.start(), m.end(), "".join(_digit_word[w.lower()] for w in _letters.findall(m.group()))) for m in _spelled.finditer(step)]
    if edits:
        step, origin = _apply(step, edits)
        origins.append(origin)
    return step, origins[::-1]


def _spelled_hint(low: str) -> bool:
    """Six digit words or more in a row; most texts have no two of the ten, which is cheap to see."""
    seen = ("five" in low) + ("one" in low) + ("two" in low) + ("four" in low) + ("seven" in low) + ("three" in low) + ("nine" in low) + ("zero" in low) + ("six" in low) + ("eight" in low) + ("oh" in low)
    return seen > 0 and _two_spelled.search(low) is not None and _spelled.search(low) is not None


def _word_start(text: str, at: int) -> int:
    while at and text[at - 1].isalpha():
        at -= 1
    return at


def _apply(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Origin]:
    """The text with replacements, and the origin of each part; overlapping later edits are left out."""
    parts, origin, at, here = [], [], 0, 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        if a > at:
            parts.append(text[at:a])
            origin.append((here, a - at, at, a - at))
            here += a - at
        if new:
            parts.append(new)
            origin.append((here, len(new), a, b - a))
            here += len(new)
        at = b
    if at < len(text):
        parts.append(text[at:])
        origin.append((here, len(text) - at, at, len(text) - at))
    return "".join(parts), origin


def _span(a: int, b: int, origins: list[Origin]) -> tuple[int, int]:
    """The span of the source that a span, not empty, of the normalised text comes from."""
    for origin in origins:
        a, b = _place(a, origin, False), _place(b - 1, origin, True)
    return a, b


def _place(at: int, origin: Origin, end: bool) -> int:
    """Where the character here begins there, or ends; a part whose lengths differ counts as a whole."""
    here, length, there, source = origin[bisect_right(origin, at, key=itemgetter(0)) - 1]
    if length == source:  # character by character
        return there + at - here + end
    return there + (source if end else 0)


def _pairs(s: str) -> Iterator[tuple[int, int, str, str, bool, bool]]:
    """(start, end, first, last, whether what stands around says it is a person, whether the first is a listed name) of
    every pair of capitalised words that could be a name."""
    for m in _pair.finditer(s):
        first, last = m.groups()
        if first in _not_named or not _could_be(first, last):
            continue
        own = last.endswith(("'s", "’s"))
        end = m.end(2) - 2 * own
        cued = not (first.isupper() and last.isupper()) and bool(_cue_before.search(s[max(0, m.start() - 24) : m.start()]) or _cue_after.match(s, end))
        yield m.start(), end, first, last[:-2] if own else last, cued, first in _named


def detect(text: str | None, author: bool = False, model: NameModel | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source text, in order and without overlap; of overlapping finds the kind that
    comes first in PLACEHOLDERS is kept.  author: the text is a name field, a whole value of which is a name.
    model: also takes pairs for names that no rule knows, and a listed first word with a common second one for none."""
    if not text:
        return []
    s, origins = normalised(text)
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in s:
        for m in _email.finditer(s):
            add(m.start(), m.end(), "email")
    if _numbers.search(s):
        for p in _ids if _id_hint.search(s) else ():
            for m in p.finditer(s):
                add(m.start("n"), m.end("n"), "id_number")
        if origins and _spelled_hint(text.lower()):
            for m in _run.finditer(s):
                if not any(c.isdigit() for c in text[slice(*_span(m.start(), m.end(), origins))]):
                    add(m.start(), m.end(), "phone")  # its digits were words
        for p in _phones:
            for m in p.finditer(s):
                if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                    add(m.start(), m.end(), "phone")
    if _digit.search(s):
        low = s.lower()
        for p, hints in zip(_addresses, _address_hints):
            if any(h in low for h in hints) if hints else _number_word.search(s):
                for m in p.finditer(s):
                    add(m.start(), len(m.group().rstrip(" ,")) + m.start(), "street_address")
    if "Mr" in s or "Ms" in s or "Dr" in s or "Miss" in s or "Mx" in s or "Prof" in s or "Herr" in s or "Frau" in s or "Mme" in s or "Sr" in s or "DR" in s or "MR" in s or "MS" in s or "PROF" in s:
        for m in _titled.finditer(s):
            if m["n"].split()[-1] not in _not_named:
                add(m.start(), m.end(), "person_name")
    if author:
        if (m := _author.fullmatch(s.strip())) and _could_be(*re.findall(r"[\w'’-]+", re.sub(r"\(.*", "", s))[:2]):
            at = s.index(s.strip())
            add(at, at + len(re.sub(r" \(.*", "", s.strip())), "person_name")
    else:
        for a, b, first, last, cued, listed in _pairs(s):
            if cued or listed and not (model and model.common_pair(last)) or model and not listed and model.probability(s, a, b, first, last) >= LEAST:
                add(a, b, "person_name")
        if ". " in s:
            for m in _initialled.finditer(s):
                if m["n"] not in NOT_NAMES and m.start() and s[m.start() - 1] in " \n" and s[: m.start()].rstrip()[-1:] not in ".!?" and re.search(r"(?i)\b(?:by|from|contact|ask|for|with|to|and|signed,?|is|says|said)\s$", s[: m.start()][-12:]):
                    add(m.start(), m.end(), "person_name")
    return sorted((*_span(a, b, origins), kind) for a, b, kind in found)


def redacted(text: str | None, author: bool = False, model: NameModel | None = None) -> str | None:
    """The text with every find replaced by its kind's placeholder and all other characters kept."""
    out, at = [], 0
    for a, b, kind in detect(text, author, model):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:] if out else text


def _comments(value: str) -> list | None:
    try:
        found = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, list) else None


def kinds(value: str | None, how: str, model: NameModel | None = None) -> list[str]:
    """The kinds that occur in a value: a text, an author's name, or a JSON list of texts (as plain text where malformed)."""
    if not value:
        return []
    if how == "json" and (found := _comments(value)) is not None:
        texts = [x for x in found if isinstance(x, str)]
        return sorted({kind for x in texts for _, _, kind in detect(x, model=model)})
    return sorted({kind for _, _, kind in detect(value, how == "author", model)})


def redacted_value(value: str | None, how: str, model: NameModel | None = None) -> str | None:
    """redacted() of a value of any of the three sorts; a JSON list without finds stays as it is written."""
    if not value:
        return value
    if how == "json" and (found := _comments(value)) is not None:
        clean = [redacted(x, model=model) if isinstance(x, str) else x for x in found]
        return value if clean == found else json.dumps(clean, ensure_ascii=value.isascii())
    return redacted(value, how == "author", model)


#: Fields of the domain table and the sort of text in each.
FIELDS = {"body": "text", "author_name": "author", "comment_sample_json": "json"}


def _narrow(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(fields)))


#: Different words and pairs that a task holds before it passes their counts on, and different pairs up to which they are
#: fitted in the driver.
HELD, SMALL = 100_000, 200_000
_int = np.dtype("<i4")


def _pair_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the features, whether it is a name, how often it occurs) of the pairs in a batch."""
    numbers = np.frombuffer(b"".join(batch.column("numbers").to_pylist()), _int).reshape(-1, AROUND + ALIKE)
    return numbers, batch.column("name").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()


def fit_names(df: DataFrame, text_col: str = "body") -> NameModel:
    """The model of names, fitted on all distinct texts of the column.

    The rules label the pairs of capitalised words in them; titles, cues and listed given names are the names.  Pairs with
    the same features are counted together.  The common words, which the model has, reach the driver, and up to SMALL
    different pairs as numbers; with more pairs each step of the fit is a sum over all of them in tasks, with the same
    result.  Null texts don't count."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = df.select(F.col(text_col).cast("string").alias("t")).where("t is not null").repartition(parts, "t").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen, pairs = 0, Counter(), Counter()

        def held() -> pa.RecordBatch:
            lower = {w: n for w, n in seen.items() if in_lower_case(w)} | {"": texts}
            columns = list(zip(*pairs)) or [()] * 6
            kinds = pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_()
            arrays = [pa.array([*lower, *[None] * len(pairs)], pa.string()), *(pa.array([*[None] * len(lower), *c], kind) for c, kind in zip(columns, kinds)), pa.array([*lower.values(), *pairs.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["w", "first", "last", "numbers", "opens", "cued", "listed", "n"])

        for batch in batches:
            for t in batch.column("t").to_pylist():
                s, _ = normalised(t)
                texts += 1
                seen.update(words(s))
                for a, b, first, last, cued, listed in _pairs(s):
                    around, alike, opens = plain_features(s, a, b, first, last)
                    pairs[first.lower(), last.lower(), np.array([*map(number, around), *map(number, alike)], _int).tobytes(), opens, cued, listed] += 1
                if len(seen) + len(pairs) > HELD:
                    yield held()
                    texts, seen, pairs = 0, Counter(), Counter()
        yield held()

    counts = cut(texts.mapInArrow(scan, "w string, first string, last string, numbers binary, opens boolean, cued boolean, listed boolean, n long"))
    total = counts.where("w = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = counts.where("w != ''").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON, COMMON * total / TEXTS))
    common = frozenset(r.w for r in seen.collect())
    sent = spark.sparkContext.broadcast(common)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, numbers, opens, cued, listed = (batch.column(c).to_pylist() for c in ("first", "last", "numbers", "opens", "cued", "listed"))
            more = [np.array([number(f) for f in common_features(a, b, o, sent.value)], _int).tobytes() for a, b, o in zip(first, last, opens)]
            name = [c or x and b not in sent.value for c, x, b in zip(cued, listed, last)]
            yield pa.RecordBatch.from_arrays([pa.array([a + b for a, b in zip(numbers, more)], pa.binary()), pa.array(name, pa.bool_()), batch.column("n")], ["numbers", "name", "n"])

    schema = "numbers binary, name boolean, n long"
    pairs = cut(counts.where("w is null").drop("w").mapInArrow(label, schema).groupBy("numbers", "name").agg(F.sum("n").alias("n")))
    kinds = {r.name: r for r in pairs.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    if any(k not in kinds or kinds[k].n < FEWEST for k in (True, False)):
        return NameModel.none(common)
    if sum(r.rows for r in kinds.values()) <= SMALL:
        numbers, name, n = _pair_rows(pairs.toArrow().combine_chunks().to_batches()[0])
        return fit(lambda weights: slopes(numbers, name, n, weights), uses(numbers, n), common)

    def summed(made: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 << BITS) + 1, np.int64)
            for batch in batches:
                total += made(*_pair_rows(batch))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

        found = pairs.mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((1 << BITS) + 1, np.int64)
        total[found.column("at").to_numpy()] = found.column("n").to_numpy()
        return total

    def slope(weights: np.ndarray) -> np.ndarray:
        there = spark.sparkContext.broadcast(weights.copy())
        try:
            return summed(lambda numbers, name, n: slopes(numbers, name, n, there.value))
        finally:
            there.destroy()

    return fit(slope, summed(lambda numbers, name, n: uses(numbers, n)), common)


def find_personal(df: DataFrame, id_col: str = "id", fields: dict[str, str] = FIELDS, *, model: NameModel | None = None) -> DataFrame:
    """(id, field_name, pii_kind), once for each row, field and kind that occurs in it.

    model: as of fit_names(); without one only rules tell names.

    Null, empty and blank values have none; a malformed JSON value is searched as plain text; repeated rows are
    each reported; an empty table gives an empty result; other columns aren't read.  Nothing is shuffled."""

    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, ids = [], batch.column("id").to_pylist()
            for k, (field, how) in enumerate(fields.items()):
                for i, value in enumerate(batch.column(f"f{k}").to_pylist()):
                    rows += [(ids[i], field, kind) for kind in kinds(value, how, sent.value)]
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["id", "field_name", "pii_kind"])

        return handle

    return per_batch(_narrow(df, id_col, fields), make, "id long, field_name string, pii_kind string")


def redact(df: DataFrame, id_col: str = "id", fields: dict[str, str] = FIELDS, *, model: NameModel | None = None) -> DataFrame:
    """(id and the fields): the same rows with every find replaced by its placeholder, other text kept as it is."""

    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            clean = [pa.array([redacted_value(v, how, sent.value) for v in batch.column(f"f{k}").to_pylist()], pa.string()) for k, how in enumerate(fields.values())]
            return pa.RecordBatch.from_arrays([batch.column("id"), *clean], ["id", *fields])

        return handle

    return per_batch(_narrow(df, id_col, fields), make, "id long, " + ", ".join(f"`{c}` string" for c in fields))
