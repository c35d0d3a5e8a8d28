"""Personal information in free text: finding it and replacing it.

Direct identifiers (mail addresses, telephone and identity numbers, street
addresses) are found by the grammar of their notation.  Names have none, so
they are found by how strongly their terms reveal persons in this corpus:

1. Every pair of adjacent capitalised terms, in any notation of a name, is a
   *mention*: its leading and its trailing term.
2. Protected evidence for a mention is an honorific or a signature mark before
   it, or a mail address made of the same term.  Corpus co-occurrence counts,
   per term and place, how often it is mentioned and how often with evidence.
   A term's *disclosure* is the information it gives, log2 of P(person | term)
   over P(person), as a share of all there is to learn, log2 of 1 / P(person);
   counts are shrunk towards the corpus rate.
3. Given names are the leading terms whose disclosure exceeds the threshold.
   They are evidence for the terms they stand with, so a second count gives
   the disclosure of family names.
4. A mention whose terms both exceed the threshold is a name and is replaced.

Mentions are small rows; counts are partially aggregated before each shuffle,
and no table of terms is held by the driver or sent to all executors by force.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import materialise

# Words that announce persons, words of street names and labels of
# identity numbers in English, German, French and Spanish.
HONORIFICS = "Mr Mrs Ms Miss Mx Dr Prof Sir Madam Mme Mlle Monsieur Madame Herr Frau Herrn Señor Señora Sr Sra Don Doña Dña".split()
STREETS_AFTER = (
    "Street St Avenue Ave Road Rd Lane Ln Court Ct Drive Dr Boulevard Blvd Parkway Pkwy Terrace Ter Close Mews Way Place Pl Square Sq "
    "Crescent Highway Hwy Circle Trail Row Gardens Grove Hill Quay Alley"
).split()
STREETS_BEFORE = "rue avenue boulevard allée place chemin quai impasse route cours calle avenida plaza paseo camino carrera ronda travesía via".split()
STREET_ENDS = "straße strasse str. weg gasse platz allee ring damm ufer".split()
ID_LABELS = (
    "SSN, social security number, social security no., NI number, National Insurance number, National Insurance no., NINO, passport, "
    "passport no., passport number, driver's licence, driver's license, driving licence, driver licence, licence no., tax id, tax number, "
    "Steuer-ID, Steuernummer, Steueridentifikationsnummer, Personalausweis, Ausweisnummer, Ausweis-Nr., Reisepass, Führerschein, "
    "DNI, NIE, NIF, pasaporte, carné de conducir, permiso de conducir, NIR, numéro de sécurité sociale, carte d'identité, passeport, "
    "permis de conduire, identity card, identity card no., ID card, national ID"
).split(", ")

LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)"
DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: Where a sign can be; the domain is read from there on, the local part backwards.
MAIL_SIGN = re.compile(r"@|[(\[{]\s?[Aa][Tt]\s?[)\]}]")
MAIL_WORD = re.compile(r"\s[Aa][Tt]\s")
MAIL_DOMAIN = re.compile(rf"\s?(?P<domain>{LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
MAIL_LOCAL = re.compile(rf"(?<![A-Za-z0-9])(?:{LOCAL})(?:{DOT}{LOCAL})*\s?\Z", re.I)
WINDOW = 320  # characters before a sign that are looked at first; a local part that begins there has more of them looked at

PHONE = re.compile(
    r"""[+(0-9](?:
      (?<=\+)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}           # + country code
    | (?<=0)0[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,8}\)?){2,5}            # 00 country code
    | (?<=0)[1-9]\d{1,4}(?:[ /\-]\d{2,8}){1,4}                    # national, leading 0
    | (?<=\()\d{2,5}\)[ \-]?\d{3,4}(?:[ \-]?\d{2,4}){1,3}         # (area) number
    | (?<=1)[ \-.]?\(\d{3}\)[ \-.]?\d{3}[ \-.]\d{4}
    | (?<=1)[ \-.]\d{3}[ \-.]\d{3}[ \-.]\d{4}
    | (?<=[2-9])\d{2}(?P<s>[.\-\ ])\d{3}(?P=s)\d{4}
    | (?<=[2-9])\d{2}[2-9]\d{6}
    )(?:\ ?(?:ext\.?|x|extension)\ ?\d{1,5})?(?!\w)""",
    re.X,
)
#: The core of an identity number: six digits or more, perhaps with letters or in groups.
ID_CORE = re.compile(r"\d(?:[ \-]?[\dA-Z]){5,}")
ID_PREFIX = re.compile(r"(?:(?<![A-Za-z0-9])[A-Z]{2} |[A-Z]{1,3})\Z")
ID_BARE = re.compile(r"\d{3}(?P<s>[\- ])\d{2}(?P=s)\d{4}\Z|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\Z")
ID_NI = re.compile(r"\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])")
ID_LABEL_BEFORE = re.compile(
    r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(ID_LABELS, key=len, reverse=True)) + r")(?:\s?(?:no|nr|number)\b\.?)?\s?[:#]?\s{0,2}\Z",
    re.I,
)
#: A label with what may stand around it: a sign before it, "number", a colon, two blanks.
LABEL_LENGTH = max(map(len, ID_LABELS)) + len("X number. :  ")
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]\w*)*"
_after = "|".join(re.escape(x) for x in STREETS_AFTER)
_before = "|".join(STREETS_BEFORE + [x.capitalize() for x in STREETS_BEFORE])
_ends = "|".join(re.escape(x) for x in STREET_ENDS)
ADDRESSES = [
    re.compile(
        rf"""\d{{1,5}}(?:\ ?bis|\ ?ter|[A-Za-z])?,?\ (?:
          (?:(?:[NSEW]\.|North|South|East|West)\ )?(?:{CAP}\ )+?(?:{_after})\b(?!\ (?:{_after})\b)
        | (?:{_before})\ (?:(?:de\ la|de\ l['’]|du|des|de|del|d['’])\ ?)?{CAP}
        )""",
        re.X,
    ),
    re.compile(rf"(?:{_before})\ (?:(?:de\ la|del|de|du)\ )?{CAP},?\ \d{{1,5}}\b(?!\d)", re.X),
]
#: German streets named by a place, told by the postal code behind the house number: "Unter den Linden 5, 10117 Berlin".
ADDRESS_AT = re.compile(
    rf"""[AHIUVZ](?<!\w.)(?:
        (?<=A)m | (?<=A)n\ der | (?<=A)uf\ (?:dem|der) | (?<=H)inter\ (?:dem|der) | (?<=I)m | (?<=I)n\ (?:der|den)
      | (?<=U)nter\ (?:dem|den|der) | (?<=V)or\ (?:dem|der) | (?<=Z)u[mr]
    )(?:\ {CAP})+\ \d{{1,4}}[a-z]?(?=,?\ \d{{5}}\ {CAP})""",
    re.X,
)
ADDRESS_END = re.compile(rf"(?:{_ends})\ \d{{1,5}}[a-z]?\b")
FLAT_BEFORE = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit) \d{1,4}[A-Za-z]?, \Z")
WORD_BEFORE = re.compile(r"[A-ZÄÖÜ]\w*\Z")

#: Possessive repeats: long runs of letters cost their length, not its square, whatever they are.
TERM = r"[^\W\d_]++(?:[-'’][^\W\d_]++)*+"
NAME = re.compile(  # one capital, then by looking ahead the rest of both terms, so that mentions may overlap
    rf"(?P<i>[A-ZÀ-ÖØ-Þ])(?<![\w@'’-].)(?=(?P<a>\.|{TERM})(?P<sep>,?[\ \n])(?:(?P<mid>[A-ZÀ-ÖØ-Þ]\.)[\ \n])?(?P<b>[A-ZÀ-ÖØ-Þ]{TERM})(?!\w))"
)
CUE = re.compile(r"(?:\b(?:" + "|".join(HONORIFICS) + r")\.?|\bM\.|/s/)\s$")


def mail_addresses(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, also written with words or blanks for their signs."""
    signs = [*MAIL_SIGN.finditer(text), *MAIL_WORD.finditer(text)]
    out = []
    for sign in signs:
        domain = MAIL_DOMAIN.match(text, sign.end())
        web = domain and sign.re is MAIL_WORD and domain["domain"].lower().startswith("www")  # "available at www.acme.test"
        if domain and not web:
            back = WINDOW
            low = max(0, sign.start() - back)
            local = MAIL_LOCAL.search(text[low : sign.start()])
            while local and local.start() == 0 and low:
                back *= 2
                low = max(0, sign.start() - back)
                local = MAIL_LOCAL.search(text[low : sign.start()])
            if local:
                out.append((low + local.start(), domain.end("domain")))
    return out


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of street addresses, from the house number, flat or street word on."""
    for pattern in ADDRESSES:
        for m in pattern.finditer(text):
            flat = FLAT_BEFORE.search(text[max(0, m.start() - 20) : m.start()])
            yield m.start() - (len(flat.group()) if flat else 0), m.end()
    for m in ADDRESS_AT.finditer(text):
        yield m.span()
    for m in ADDRESS_END.finditer(text):
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        word = WORD_BEFORE.search(text[start : m.start()])
        if word:
            yield m.start() - len(word.group()), m.end()


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all direct identifiers, without overlaps.

    Where notations overlap, the earlier of mail address, identity number,
    telephone number and street address wins.
    """
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))  # marks the characters taken, so that long texts with many places stay cheap

    def free(start: int, end: int) -> bool:
        return used.find(1, start, end) < 0

    def take(start: int, end: int, kind: str) -> None:
        used[start:end] = b"\1" * (end - start)
        taken.append((start, end, kind))

    def loose(start: int, end: int) -> bool:
        """Not a part of a longer number, word or amount."""
        before, after = text[max(0, start - 2) : start], text[end : end + 2]
        if before and (before[-1].isalnum() or before[-1] in "$€£#_/@" or (before[-1] in ".,-" and before[:1].isdigit())):
            return False
        return not (after[:1].isalnum() or after[:1] in ("_", "%") or (after[:1] in ".,-/" and after[1:].isdigit()))

    for s, e in mail_addresses(text):
        if free(s, e):
            take(s, e, "email")
    for m in ID_CORE.finditer(text):
        prefix = ID_PREFIX.search(text[max(0, m.start() - 4) : m.start()])
        start = m.start() - (len(prefix.group()) if prefix else 0)
        insurance = ID_NI.match(text, m.start()) if prefix else None
        end = insurance.end() if insurance else m.end()
        while text[end - 1].isupper() and text[end : end + 1].islower():  # the next word's first letter
            end -= 1 if text[end - 2] not in " -" else 2
        labelled = ID_LABEL_BEFORE.search(text[max(0, start - LABEL_LENGTH) : start])
        if not labelled and prefix and prefix.group()[-1] == " ":  # a word such as "ID " is no part of the number
            other = ID_LABEL_BEFORE.search(text[max(0, m.start() - LABEL_LENGTH) : m.start()])
            start, labelled = (m.start(), other) if other else (start, None)
        digits = sum(map(str.isdigit, text[start:end]))
        bare = ID_BARE.match(text[start:end]) and loose(start, end)
        if digits >= 6 and (labelled or bare) and free(start, end):
            take(start, end, "id_number")
    for m in PHONE.finditer(text):
        start, end = m.span()
        while end and not loose(start, end):  # leave out trailing groups that belong to what follows
            end = max(text.rfind(" ", start, end), 0)
        digits = sum(c.isdigit() for c in text[start:end].split("ext")[0])
        if 7 <= digits <= 15 and free(start, end):
            take(start, end, "phone")
    for s, e in addresses(text):
        before = text[s - 1 : s]
        if not (before.isalnum() or before in set("$€£.,")) and free(s, e):
            take(s, e, "address")
    return sorted(taken)


def mentions(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, str, bool]]:
    """``(start, end, form, leading, trailing, cue)`` of all pairs of capitalised terms.

    Forms: 'given family', 'initial family' and 'family, given' (``leading`` is
    always the given name).
    """
    out = []
    used = bytearray(len(text))
    for s, e, _ in taken:
        used[s:e] = b"\1" * (e - s)
    for m in NAME.finditer(text):
        start = m.start()
        a, b, sep = m["i"] + m["a"], m["b"], m["sep"]
        end = m.end("b")
        if used.find(1, start, end) >= 0:
            continue
        if len(a) < 2 or len(b) < 2:
            continue
        comma = sep[0] == ","
        if a.endswith("."):
            if comma or m["mid"]:
                continue
            form, given, family = "initial", "", b
        elif comma:
            if m["mid"]:
                continue
            form, given, family = "comma", b, a
        else:
            form, given, family = "plain", a, b
        cue = bool(CUE.search(text[max(0, start - 12) : start]))
        out.append((start, end, form, given.lower(), family.lower().split("-")[0], cue))
    return out


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per identifier and per mention of two capitalised terms."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["id", "kind", "start", "end", "form", "given", "family", "cue"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[] for _ in names[1:]]
            for row, t in enumerate(batch.column(1).to_pylist()):
                taken = identifiers(t)
                for s, e, k in taken:
                    at.append(row)
                    local = re.split(r"[.+_\-0-9@(\[ ]", t[s:e].lower())[:2] if k == "email" else ["", ""]
                    for c, v in zip(cols, (k, s, e, None, local[0], local[1] if len(local) > 1 else "", False)):
                        c.append(v)
                for s, e, form, given, family, cue in mentions(t, taken):
                    at.append(row)
                    for c, v in zip(cols, ("name", s, e, form, given, family, cue)):
                        c.append(v)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, types)], names
            )

    source = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(find, f"id {kind}, kind string, start long, end long, form string, given string, family string, cue boolean")


def disclosure(found: DataFrame, term: str, evidence: F.Column, shrink: float = 2.0) -> DataFrame:
    """``(term, share)``: how much each term reveals that a person is meant, at most 1.

    ``found`` has one row per occurrence of a term, ``evidence`` says whether it
    stands with protected evidence.  A term's share with evidence is shrunk by
    ``shrink`` occurrences at the corpus rate.
    """
    total = found.agg(F.avg(evidence.cast("double")).alias("rate")).first()["rate"]
    rate = min(max(total or 0.0, 1e-9), 0.999)
    counts = found.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.sum(evidence.cast("long")).alias("c"))
    bits = F.log2((F.col("c") + shrink * rate) / (F.col("n") + shrink) / rate)
    return counts.select(F.col(term).alias("term"), (bits / -math.log2(rate)).alias("share"))


def apart(spans: DataFrame) -> DataFrame:
    """``(id, start, end)``: the spans of each id by place, without those that overlap the last one kept.

    In "A B, C D" the spans are "A B", "B, C" and "C D": the second is left out
    and so does not stand in the way of the third.
    """
    kind = spans.schema["id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0  # an id's rows may go on in the next batch
        for batch in batches:
            at = []
            for row, (key, s, e) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if key != last or s >= end:
                    at.append(row)
                    last, end = key, e
            yield batch.take(pa.array(at, pa.int64()))

    placed = spans.select("id", "start", "end").repartition("id").sortWithinPartitions("id", "start", "end")
    return placed.mapInArrow(keep, f"id {kind}, start long, end long")


def personal_spans(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.4) -> DataFrame:
    """``(id, kind, start, end)`` of all personal information, by place.

    Kinds are email, phone, id_number, address and name; positions count
    characters from 0.  Null keys and null or empty texts give no row; repeated
    rows count once; an empty table gives none; extra columns are ignored.
    """
    found = materialise(scan(rows, key, text), "personal")
    direct = found.filter(F.col("kind") != "name").select("id", "kind", "start", "end").distinct()
    pairs = found.filter(F.col("kind") == "name").select("id", "start", "end", "form", "given", "family", "cue")
    mail = found.filter(F.col("kind") == "email").select(F.explode(F.array("given", "family")).alias("term")).filter(F.length("term") > 2)
    mailed = mail.select("term", F.lit(True).alias("cue"))

    leading = pairs.filter(F.col("form") != "initial").select(F.col("given").alias("term"), "cue").unionByName(mailed)
    given = disclosure(leading, "term", F.col("cue")).filter(F.col("share") >= threshold)
    known = pairs.join(given.select(F.col("term").alias("given"), F.lit(True).alias("is_given")), "given", "left").withColumn(
        "is_given", F.coalesce("is_given", F.lit(False))
    )
    trailing = known.select(F.col("family").alias("term"), (F.col("cue") | F.col("is_given")).alias("cue")).unionByName(mailed)
    family = disclosure(trailing, "term", F.col("cue")).filter(F.col("share") >= threshold)
    likely = known.filter(F.col("is_given") | (F.col("form") == "initial"))
    named = likely.join(family.select(F.col("term").alias("family")), "family", "left_semi")
    names = apart(named.select("id", "start", "end").distinct())
    return direct.unionByName(names.select("id", F.lit("name").alias("kind"), "start", "end"))


def redact(rows: DataFrame, key: str = "doc_id", text: str = "text", spans: DataFrame | None = None) -> DataFrame:
    """``(id, text)`` with a typed placeholder such as [EMAIL] at each place.

    Everything else stays as stored; null texts stay null.  Keys are unique.
    """
    spans = personal_spans(rows, key, text) if spans is None else spans
    kind = rows.schema[key].dataType.simpleString()
    places = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("places"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t is not None and found:
                    parts, at = [], 0
                    for p in found:
                        if p["start"] >= at:
                            parts += [t[at : p["start"]], f"[{p['kind'].upper()}]"]
                            at = p["end"]
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    source = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).join(places, "id", "left")
    return source.mapInArrow(replace, f"id {kind}, text string")
