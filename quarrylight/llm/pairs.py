"""Defects of question-answer pairs.

Each sample is judged by itself, in Arrow batches, by four recognisers:

* *truncated*: a pushdown parser reads fences, brackets, quotations, mark-up
  and list items; what is left open at the end, or an end inside a sentence, is
  a truncation.
* *copied_question*: greedy string tiling covers the answer with tiles of the
  question; an answer with nearly nothing beside the tiles is a copy.
* *other_language*: script checks and word probabilities by language.
* *refusal*: a grammar of clauses (apology, inability, missing material), tried
  on every sentence.

The recognisers run in the order empty, refusal, copied question, other
language, truncated, so no sample has two defects.

What words a language has, and which of them end no phrase, is learnt from
labelled texts (``learn``): a classifier fitted to a bounded sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled texts that the language classifier is fitted to
LEXICON = 4_000  # words kept of each language, the most frequent
FREQUENT = 150  # of these so many are asked whether they ever end a phrase
LEAST_SHARE = 0.02  # labels with less of the sample are taken for errors
LEAD, MEAN_LEAD = 5.0, 0.5  # nats by which another language must lead, in all and per known word


@dataclass(frozen=True)
class Profile:
    """Languages, the log probabilities of words in each, and words that end no phrase."""

    languages: tuple[str, ...] = ()
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    open_words: frozenset[str] = frozenset()


def learn(texts: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profile:
    """The profile of labelled texts: about ``sample`` of them, those with the least hashes of their keys; rare labels are left out.

    Null texts, labels and keys take no part; an empty table gives a profile that knows no language.
    """
    label = F.lower(F.trim(lang))
    known = texts.filter(F.col(key).isNotNull() & (label != ""))
    share = sample / max(sample, known.count())
    chosen = F.pmod(F.xxhash64(F.lit("language"), key), F.lit(2**40)) < int(share * 2**40)
    drawn = known.filter(chosen & F.col(text).isNotNull()).select(label.alias("lang"), F.lower(text).alias("text"))
    # a word, with the mark or line break behind it that ends its phrase if there is one
    found = F.regexp_extract_all("text", F.lit(r"\p{L}+(?:[.,;:!?…)\]\n|])?"), F.lit(0))
    each = drawn.select("lang", F.explode(found).alias("w")).select("lang", F.regexp_extract("w", r"^\p{L}+", 0).alias("word"), F.col("w").rlike(r"\P{L}").alias("ends"))
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ends").cast("int")).alias("ended"))
    totals = counts.withColumn("total", F.sum("n").over(W.partitionBy("lang")))
    first = totals.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= LEXICON)
    rows = first.collect()  # languages x LEXICON rows at most
    every = sum({r.lang: r.total for r in rows}.values())
    totals_of = {r.lang: r.total for r in rows if r.total >= LEAST_SHARE * every}
    languages = tuple(sorted(totals_of))
    n = {(r.lang, r.word): r.n for r in rows}
    lexicon = {r.word for r in rows if r.lang in totals_of}
    words_ = {w: tuple(math.log((n.get((g, w), 0) + 0.5) / (totals_of[g] + 0.5 * len(lexicon))) for g in languages) for w in lexicon}
    closed = frozenset(r.word for r in rows if r.lang in totals_of and r.place <= FREQUENT and r.n >= 30 and r.ended < 0.003 * r.n)
    return Profile(languages, words_, closed)


#: Answers that stand for none.
PLACEHOLDERS = "none null nil nan n/a na - -- --- — – . .. ... … ? [] {} () \"\" '' undefined tbd todo unknown missing".split()

LABEL = re.compile(r"^\s*(?:final\s+)?(?:answer|response|output|result|a|antwort|réponse|respuesta|question|q|frage|pregunta|you asked)\s*[:：]\s*", re.I)
CITATION = re.compile(r"\s*\[\s*\^?#?\d+(?:\s*[,;]\s*\^?#?\d+)*\s*\]")
THINKING = re.compile(r"<(think|thinking|analysis|reasoning|scratchpad)>.*?(?:</\1>|\Z)", re.I | re.S)
TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>")
FENCE = re.compile(r"^\s*```[\w+-]*\s*$", re.M)
WORD = re.compile(r"[^\W_]+", re.U)
LETTERS = re.compile(r"[^\W\d_]+", re.U)

#: Clauses of refusals by language.
APOLOGY = {
    "en": r"(?:i(?:'m| am) (?:very |so |terribly )?(?:sorry|afraid)|i apologi[sz]e|my apologies|sorry|unfortunately|regrettably|as an ai(?: \w+){0,3}|at this time)",
    "de": r"(?:es tut mir leid|tut mir leid|leider|bedauerlicherweise|entschuldigung|ich bedaure|als ki\w*)",
    "fr": r"(?:je (?:suis )?d[ée]sol[ée]e?|d[ée]sol[ée]e?|malheureusement|je regrette|en tant qu'ia)",
    "es": r"(?:lo siento|lo lamento|lamentablemente|desafortunadamente|disculpe|como ia)",
}
INABILITY = {
    "en": [
        r"(?:i|we)(?: \w+)? (?:can ?not|can't|cannot|could not|couldn't|am unable to|are unable to|am not able to|won't|will not|must decline|have to decline|decline|would rather not|prefer not)\b",
        r"(?:i|we) (?:do not|don't) (?:have|possess) (?:enough|sufficient|the|any|access)\b.{0,40}(?:information|data|material|context|evidence|access)?",
        r"(?:it is|it's) not possible (?:for me )?to\b",
        r"(?:falls|lies|is) outside (?:of )?(?:what|my|the scope)",
        r"(?:request|question|answer)(?: is| has been| was)? (?:declined|refused|denied)",
        r"(?:excerpts?|evidence|context|documents?|material|information|passages?)(?: \w+){0,4} (?:do not|does not|don't|doesn't|is not|are not|isn't|aren't|not) (?:contain|include|provide|sufficient|enough|give|state|allow)",
        r"(?:insufficient|not enough) (?:information|evidence|context|data)",
        r"not (?:comfortable|permitted|allowed) (?:to|with)\b",
        r"unable to (?:answer|help|provide|assist|determine)",
    ],
    "de": [
        r"(?:kann|darf|könnte|möchte|werde) (?:ich|wir)?.{0,60}\b(?:nicht|keine)\b.{0,60}\b(?:beantworten|geben|sagen|nennen|helfen|äußern|mitteilen)",
        r"(?:ich|wir) (?:kann|können|darf|dürfen|möchte).{0,60}\b(?:nicht|keine)\b",
        r"liegen (?:mir|uns).{0,40}\bkeine\b",
        r"nicht in der lage",
    ],
    "fr": [
        r"je ne (?:peux|suis|puis|saurais|souhaite|dispose)\b.{0,30}\b(?:pas|en mesure)?",
        r"ne (?:me|nous) permettent? pas de",
        r"il (?:m'est|n'est pas) (?:im)?possible",
    ],
    "es": [
        r"no (?:puedo|podemos|estoy|estamos|dispongo|tengo|me es posible|es posible)\b",
        r"no (?:me|nos) permiten?\b",
        r"(?:extractos?|documentos?|información)\b.{0,30}\bno (?:contienen?|incluyen?|permiten?|bastan?|es suficiente)",
    ],
}
#: Wording of "not disclosed" in answers that the filing itself gives.
NONDISCLOSURE = re.compile(
    r"not (?:been )?disclosed|does not (?:disclose|report|state|break out)|doesn't disclose|no information on|gives no (?:information|figure)|not (?:reported|stated|available|provided) in|"
    r"nicht (?:angegeben|offengelegt|ausgewiesen|enthalten)|keine angaben|n'est pas (?:communiqu|publi|indiqu|divulgu)|ne (?:communique|publie|précise|divulgue) pas|no (?:se )?(?:divulga|revela|publica|informa|indica)",
    re.I,
)
REFUSALS = {
    lang: re.compile(r"^\W*(?:" + APOLOGY[lang] + r"\W*(?:(?:but|aber|mais|pero|and|that)\W+)?)*(?:.{0,40}?)(?:" + "|".join(INABILITY[lang]) + r")", re.I | re.S)
    for lang in APOLOGY
}

#: Refusals that begin a later sentence: an apology or the speaker, then the inability.
LATER_REFUSALS = {
    lang: re.compile(r"^\W*(?:" + APOLOGY[lang] + r"\W*(?:(?:but|aber|mais|pero|and|that)\W+)?)*(?:" + "|".join(INABILITY[lang]) + r")", re.I | re.S)
    for lang in APOLOGY
}

PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
LIST_MARK = re.compile(r"[ \t]*(?:[-*•–]|\d{1,2}[.)])(?=\s|\Z)")


def stripped(answer: str) -> str:
    """The answer without thinking blocks, tags, citation marks, fences and labels."""
    text = THINKING.sub(" ", answer)
    text = FENCE.sub("", TAG.sub(" ", text))
    text = CITATION.sub("", text).strip()
    while (m := LABEL.match(text)) and m.end():
        text = text[m.end() :].strip()
    return text


def is_empty(answer: str | None) -> bool:
    """No answer, or only a placeholder, mark-up, a label, thinking or citation marks."""
    if answer is None:
        return True
    text = "".join(c for c in stripped(answer) if unicodedata.category(c) != "Cf").strip()
    if text.lower().strip(" \t\n`*_\"'") in ("", *PLACEHOLDERS) or text.lower() in PLACEHOLDERS:
        return True
    return not any(c.isalnum() for c in text)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tile(a: list[str], b: list[str], least: int = 2) -> int:
    """Words of ``a`` covered by greedy string tiling with ``b`` (longest tiles first)."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    while True:
        best = (0, 0, 0)
        for i, w in enumerate(a):
            if used_a[i] or len(a) - i <= best[0]:
                continue
            for j in places.get(w, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for x in range(n):
            used_a[i + x] = used_b[j + x] = True
        covered += n


def copies_question(question: str, answer: str) -> bool:
    """The answer only repeats the question, but for case, marks, labels or a few words."""
    q, a = words(question), words(stripped(answer))
    if len(q) < 4 or len(a) < 0.5 * len(q):
        return False
    spare = max(2, 0.15 * len(a))
    own = set(q)
    if sum(w not in own for w in a) > spare:  # no tile covers these words
        return False
    # whole repeats are tiles of their own; only the rest is tiled
    rest, whole = re.subn(rf"(?<= ){re.escape(' '.join(q))}(?= )", "", f" {' '.join(a)} ")
    rest = rest.split()
    covered = len(a) - len(rest) + tile(rest, q if whole else q * -(-len(a) // len(q)), 1)
    return len(a) - covered <= spare and covered >= 0.6 * len(q)


def language(text: str, profile: Profile) -> tuple[list[float], int]:
    """The log probability of a text's known words in each language, and their number."""
    known = [profile.words[w] for w in LETTERS.findall(text.lower()) if w in profile.words]
    return [sum(c) for c in zip(*known)] if known else [0.0] * len(profile.languages), len(known)


def foreign_script(text: str) -> bool:
    """Whether more than four letters in ten are not Latin."""
    letters = [c for c in text if c.isalpha()]
    return sum(not c.isascii() and c > "\u036f" and "LATIN" not in unicodedata.name(c, "LATIN") for c in letters) > 0.4 * len(letters)


def other_language(question: str, answer: str, profile: Profile) -> bool:
    """Running text in a language other than the question's."""
    text = stripped(answer)
    if foreign_script(text) and not foreign_script(question):
        return True
    if len(profile.languages) < 2:
        return False
    asked, _ = language(question, profile)
    given, n = language(text, profile)
    own = max(range(len(asked)), key=asked.__getitem__)
    few = n < 3 and len(LETTERS.findall(text)) < 5  # a figure or a name
    if few or asked[own] - sorted(asked)[-2] < 1.0:  # or a question in no clear language
        return False
    lead = max(given) - given[own]
    return lead >= LEAD and lead >= MEAN_LEAD * n


def open_at_end(text: str) -> str | None:
    """What a pushdown parser has left open at the end of the text, if anything.

    A list mark at the beginning of a line opens an item, which the first sign
    of its content closes; a mark that is the whole text opens none.
    """
    stack: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if (i == 0 or text[i - 1] == "\n") and (not stack or stack[-1] == "item") and (m := LIST_MARK.match(text, i)) and text[:i].strip() + text[m.end() :].strip():
            if not stack:
                stack.append("item")
            i = m.end()
            continue
        if stack and stack[-1] == "item" and not c.isspace():
            stack.pop()
        if text.startswith("```", i):
            if stack and stack[-1] == "```":
                stack.pop()
            else:
                stack.append("```")
            i += 3
            continue
        if stack and stack[-1] == "```":
            i += 1
            continue
        if c == "<" and (m := TAG.match(text, i)):
            name = re.sub(r"[</>]|\s.*", "", m.group(), flags=re.S).lower()
            if m.group().startswith("</"):
                if f"<{name}" in stack:
                    while stack.pop() != f"<{name}":
                        pass
            elif not m.group().endswith("/>") and name not in ("br", "hr", "img", "p", "li"):
                stack.append(f"<{name}")
            i = m.end()
            continue
        if stack and c == PAIRS.get(stack[-1]):
            stack.pop()
        elif c == '"' or (c == "*" and text.startswith("**", i)):
            mark = c if c == '"' else "**"
            if mark in stack:
                while stack.pop() != mark:
                    pass
            else:
                stack.append(mark)
            i += len(mark)
            continue
        elif c in PAIRS and not (c == "(" and text[i - 1 : i] in (":", ";")):
            stack.append(c)
        i += 1
    return stack[-1] if stack else None


COMPLETE = re.compile(
    r"^(?:the|this|that|it|its|our|der|die|das|le|la|les|el|los|las)\b[^.!?;]{0,60}?\b(?:is|are|was|were|ist|sind|war|est|sont|était|es|son|fue)\s+(?:[A-ZÀ-Þ0-9$€£].*|(?:not )?\w+ed)$", re.I | re.S
)
FIGURE = re.compile(r"^[\s(]*[-+−–]?\s*(?:[A-Z]{2,3}\$?|[$€£¥])?\s*[-+−–(]*\d[\d.,  '’]*\)?\s*(?:%|x|×|bps?|k|m|mn|bn|b)?\s*(?:percent|per cent|prozent|pour cent|por ciento|thousand|million|billion|millions?|milliards?|millones|mio\.?|mrd\.?|tsd\.?)?(?:\s*(?:d'euros|de euros|euros?|eur|usd|dollars?|gbp|pounds?|shares))?[\s).]*$", re.I)


def open_end(text: str, profile: Profile) -> bool:
    """The last word is one that ends no phrase; capitals are names or nouns and may end one."""
    last = (WORD.findall(text) or [""])[-1]
    return last in profile.open_words


def truncated(answer: str, profile: Profile) -> bool:
    """The answer stops before its last sentence is complete."""
    text = THINKING.sub(" ", answer).strip()
    if open_at_end(CITATION.sub("", text)):
        return True
    bare = stripped(answer)
    if not bare:
        return False
    lines = [x for x in bare.splitlines() if x.strip()]
    last = lines[-1].strip()
    items = [re.match(r"\s*(?:[-*•]|\d{1,2}[.)])\s+\S", x) is not None for x in lines]
    if len(lines) > 1 and sum(items) >= len(lines) - 1 and items[-1]:
        return last[-1] in ",:;([-–—" or not words(last) or open_end(last, profile)
    if FIGURE.match(bare):
        return last[-1] in ",;(["
    if len(words(bare)) <= 3:
        return last[-1] in ",;([" or (len(words(bare)) > 1 and open_end(bare, profile))
    end = last.rstrip("\"'”’»)*_` ")
    if end and end[-1] in ".!?…。！？":
        return end.endswith(("...", "…"))
    sentence = re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ])", last)[-1]
    if end and end[-1] not in ",;:([-–—$€£" and COMPLETE.match(sentence) and not open_end(sentence, profile):
        return False
    return True


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?…])\s+|\n+", text) if x.strip()]


def refuses(answer: str, gold: str | None) -> bool:
    """Declines or claims inability although the reference answer gives an answer.

    Every sentence is tried: the opening two by the whole grammar, later ones
    only where they begin with the apology or the speaker's inability, since an
    answer may say of some figure that a filing does not contain it.  That the
    filing does not disclose it is a refusal where no other sentence has a figure.
    """
    if gold is None or not gold.strip() or is_empty(gold) or NONDISCLOSURE.search(gold):
        return False
    parts = sentences(stripped(answer))
    if any(NONDISCLOSURE.search(x) for x in parts) and not any(re.search(r"\d", x) for x in parts if not NONDISCLOSURE.search(x)):
        return True
    opening = " ".join(parts[:2])
    return any(r.match(opening) for r in REFUSALS.values()) or any(r.match(x) for x in parts[2:] for r in LATER_REFUSALS.values())


def defect_of(question: str | None, answer: str | None, gold: str | None, profile: Profile) -> str | None:
    """The sample's defect, or None."""
    if is_empty(answer):
        return "empty"
    if refuses(answer, gold):
        return "refusal"
    if question and copies_question(question, answer):
        return "copied_question"
    if question and other_language(question, answer, profile):
        return "other_language"
    return "truncated" if truncated(answer, profile) else None


def defective_pairs(samples: DataFrame, profile: Profile, key: str = "sample_id", status: str = "answer") -> DataFrame:
    """``(id, defect)`` of the samples that claim an answer and have a defect.

    ``profile`` comes from ``learn``; without languages no answer is in another one.

    The status counts apart from case and surrounding blanks.  Repeated keys
    count once; null keys give no row; a null question leaves the defects that
    need none; a null answer is 'empty'; an empty table gives no row.
    """

    shared = samples.sparkSession.sparkContext.broadcast(profile)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = shared.value
        for batch in batches:
            q, a, g = (batch.column(c).to_pylist() for c in (1, 2, 3))
            found = [defect_of(*x, profile) for x in zip(q, a, g)]
            keep = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([d for d in found if d], pa.string())], ["id", "defect"])

    claimed = F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")) == status
    asked = samples.filter(claimed & F.col(key).isNotNull()).select(F.col(key).alias("id"), "question", "predicted_answer", "gold_answer")
    kind = samples.schema[key].dataType.simpleString()
    return asked.mapInArrow(judge, f"id {kind}, defect string").dropDuplicates(["id"])
