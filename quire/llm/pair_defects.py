"""Broken prompt and response pairs.

Each pair of a source, a response and the wanted language gets at most one
defect, tested in this order:

* ``empty``: null, blank, invisible, or a mere placeholder;
* ``refusal``: a sentence of the refusal grammar, wholly or after a start, that the source does not say itself;
* ``copy``: greedy string tiling covers nearly all of the response with runs of
  the source's words (case, blanks and punctuation aside);
* ``wrong_language``: most of the response is in another script, or, within one
  script, most of its sentences use the function words of another language. A wanted language
  in Latin script without function words here is not judged;
* ``truncated``: a pushdown parser over brackets, quotations, fences and markup
  ends with something open that the source closes, or the response ends inside a
  sentence, or it is far shorter than responses to sources of this length.

A source without words to translate may stand as it is. The expected length per
language pair is the median over all pairs, so nothing is fixed to these
languages' prose. Pairs are judged in Arrow batches; nothing is grouped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Placeholders, refusal phrases, function words, scripts.
PLACEHOLDERS = {"null", "none", "nil", "nan", "n/a", "na", "tbd", "todo", "xxx", "无", "（无）", "(无)", "空", "待译", "未翻译", "译文", "翻译", "略", "translation", "target", "text", "übersetzung", "traduction", "leer", "vide", "empty", "placeholder", "untranslated"}
REFUSALS = {
    "zh": r"无法(?:继续)?(?:翻译|完成翻译|提供(?:翻译|译文)|处理(?:这一|该|此)?请求)|不(?:能|便|可以?)(?:继续)?(?:提供|翻译)[^。]{0,8}(?:译文|翻译|段落|内容)|被限制讨论|作为[^，。]{0,8}语言模型|违反[^。]{0,6}(?:政策|规定)|请提供(?:需要|要)?翻译的|没有收到(?:任何)?(?:文本|原文)|没有办法处理|拒绝(?:翻译|处理)|不予翻译",
    "en": r"(?:can(?:no|['’])?t|can not|unable to|not able to|must decline to|have to decline|won['’]t|will not|decline to)\s(?:\w+\s){0,4}?(?:translat\w*|requested translation|process(?:ing)? (?:this|the|your) request|render this|be translated|complete this request|provide (?:a|the|this) translation)|as an? (?:ai |large )*language model|violates? (?:the|our) (?:usage|content) polic|no (?:source )?text was (?:provided|received)|paste the (?:paragraph|text) again|provide the (?:source )?text",
    "de": r"(?:kann|darf|werde) ich (?:diese[nrsm]?|den|das|die|ihren?) [\w ]{0,30}?nicht (?:übersetzen|bearbeiten|wiedergeben)|nicht in der lage,[\w ,]{0,40}zu übersetzen|als (?:ki-)?sprachmodell|verstößt gegen|keinen text erhalten|nicht übersetzt werden|übersetzung [\w ]{0,12}nicht möglich|kein text (?:übermittelt|erhalten)|fügen sie den (?:text|absatz)",
    "fr": r"ne (?:peux|puis|pourrai) pas (?:traduire|traiter)|ne peut (?:pas )?être traduit|impossible de (?:traiter|traduire)|en tant que modèle|modèle de lang|enfreint|aucun texte|(?:fournir|coller|recoller) le (?:texte|paragraphe|passage)|refuse de traduire",
    "es": r"no puedo traducir|como modelo de lenguaje|no se proporcionó|infringe",
}
_REFUSAL = re.compile("|".join(REFUSALS.values()), re.I)
#: Every alternative above holds one of these, so a text without them needs no match.
REFUSAL_SIGNS = (
    "无法", "译文", "翻译", "段落", "内容", "讨论", "语言模型", "违反", "请提供", "没有收到", "没有办法", "拒绝",
    "translat", "request", "render this", "language model", "violate", "text was", "paste the", "provide the",
    "übersetz", "bearbeiten", "wiedergeben", "sprachmodell", "verstößt", "keinen text", "kein text", "fügen sie",
    "tradui", "traiter", "en tant que mod", "modèle de lang", "enfreint", "aucun texte", "fournir le", "coller le",
    "puedo traducir", "como modelo", "no se proporcion", "infringe",
)
FUNCTION_WORDS = {
    "en": "the of and in to that was with for by on at from yet while whereas nobody who if not before after both is are this which had his her their its as an it be",
    "de": "der die das und in den dem ein eine einen von mit zu im auf für dass nicht während doch ist des aus bei nach vor zum am sich auch einer eines wer wenn",
    "fr": "le la les de des du et à au aux un une en dans pour que qui pas sur par avec ne sans mais tandis se ce cette sous près voir",
    "es": "el la los las de del y en un una que por con para no se sin al como más su lo pero sobre entre",
    "it": "il lo la gli le di del della e in un una che per con non si da al dei nel sono",
    "pt": "o a os as de do da e em um uma que por com para não se no na dos das ao",
    "nl": "de het een en van in op te dat die met voor niet zijn aan er om ook uit bij",
}
_OF_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _OF_WORD.setdefault(_w, []).append(_lang)
SCRIPT_OF = {
    "zh": "han", "ja": "kana", "ko": "hangul", "ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "ar": "arabic", "fa": "arabic", "ur": "arabic",
    "el": "greek", "he": "hebrew", "hi": "devanagari", "mr": "devanagari", "ne": "devanagari", "th": "thai",
}
_SCRIPTS = {
    "han": re.compile(r"[^㐀-䶿一-鿿豈-﫿]+"), "latin": re.compile(r"[^A-Za-zÀ-ɏḀ-ỿ]+"), "cyrillic": re.compile(r"[^Ѐ-ԯ]+"), "kana": re.compile(r"[^぀-ヿ]+"),
    "hangul": re.compile(r"[^가-힯]+"), "arabic": re.compile(r"[^؀-ۿ]+"), "greek": re.compile(r"[^Ͱ-Ͽ]+"), "hebrew": re.compile(r"[^֐-׿]+"), "devanagari": re.compile(r"[^ऀ-ॿ]+"), "thai": re.compile(r"[^฀-๿]+"),
}
#: Words of a response times repeated sources from which runs are told by an automaton instead of tiles.
LONG_PAIR = 40_000
#: Letters of an alphabet that say as much as one ideograph.
LETTERS_PER_IDEOGRAPH = 3.4
_NOT_WORDS_SIGNS = re.compile(r"[<\[\\$`{&@/_\]]")
_NOT_WORDS = re.compile(
    r"(?s)https?://\S+|<[^<>]*>|\[\^[^\]]*\]|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?|\]\([^)\s]*\)|\$[^$\n]*\$|```.*?```|\{\{[^{}]*\}\}|&#?\w+;|\S+@\S+|\S*[/\\_]\S*"
)
_WORDS = re.compile(r"[^\W\d_]+")
_INVISIBLE = re.compile(r"[\s​-‏⁠-⁯﻿­　]+")
_END = re.compile(r"[。！？…।؟][”»“\"’'」』)）】\]*_`]*|[.!?][”»“\"’'」』)）】\]*_`]*(?=\s|$|[㐀-鿿“„«（<\\\[&])")
_NO_END = re.compile(r"\b(?:Fig|Abb|Tab|Nr|No|pp?|S|vol|Bd|图)\.|\d+\.(?=\s)")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "{": "}"}
_CLOSERS = set(_PAIRS.values())


def plain_words(text: str) -> str:
    """A text without addresses, markup, formulas, code and paths."""
    return _NOT_WORDS.sub(" ", text) if _NOT_WORDS_SIGNS.search(text) else text


def has_words(text: str) -> bool:
    """Whether anything in a text asks for translation."""
    return any(len(w) > 1 or not w.isascii() for w in _WORDS.findall(plain_words(text)))


def refuses(source: str | None, response: str) -> bool:
    """Whether a response declines or asks back; what the source itself says in such words is no refusal."""
    low = response.lower()
    if not any(sign in low for sign in REFUSAL_SIGNS):
        return False
    said = sum(1 for _ in _REFUSAL.finditer(response))
    return said > 0 and (source is None or said > sum(1 for _ in _REFUSAL.finditer(source)))


def is_empty(text: str | None) -> bool:
    """Null, blank, invisible, or a mere placeholder."""
    if text is None:
        return True
    bare = _INVISIBLE.sub(" ", text).strip()
    if not any(unicodedata.category(c)[0] in "LNS" for c in bare):
        return True
    core = re.sub(r"^[\[\](){}<>（）【】《》_*\-—…. ]+|[\[\](){}<>（）【】《》_*\-—…. ]+$", "", bare).lower()
    return len(bare) < 40 and (not core or core in PLACEHOLDERS)


def tiles(source: list[str], response: list[str], least: int = 3) -> int:
    """Greedy string tiling: words of the response covered by the longest common runs, none used twice."""
    covered = 0
    open_s, open_r = [True] * len(source), [True] * len(response)
    starts: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(source) - least + 1):
        starts.setdefault(tuple(source[i : i + least]), []).append(i)
    while True:
        best: list[tuple[int, int, int]] = []
        longest = least - 1
        for j in range(len(response) - least + 1):
            if not open_r[j]:
                continue
            for i in starts.get(tuple(response[j : j + least]), ()):
                # a run that goes on to the left is never the longest
                if i and j and source[i - 1] == response[j - 1] and open_s[i - 1] and open_r[j - 1]:
                    continue
                k = 0
                while i + k < len(source) and j + k < len(response) and source[i + k] == response[j + k] and open_s[i + k] and open_r[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j, k)], k
                elif k == longest and k >= least:
                    best.append((i, j, k))
        if not best:
            return covered
        for i, j, k in best:
            if all(open_s[i : i + k]) and all(open_r[j : j + k]):
                open_s[i : i + k] = [False] * k
                open_r[j : j + k] = [False] * k
                covered += k


def runs(source: list[str], response: list[str], times: int, least: int = 3) -> int:
    """Words of the response covered, from its start, by the longest runs of the source; no word more often than so many times the source has it.

    A suffix automaton of the source makes it linear in both, so it serves pairs too long for tiles().
    """
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for w in source:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            to = step[at][w]
            if length[to] > length[at] + 1:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(w) == to:
                    step[at][w] = twin
                    at = link[at]
                link[to] = twin
                to = twin
            link[new] = to
        last = new
    covered: dict[str, int] = {}
    j = 0
    while j < len(response):
        at, k = 0, j
        while k < len(response) and (to := step[at].get(response[k])) is not None:
            at, k = to, k + 1
        if k - j >= least:
            for w in response[j:k]:
                covered[w] = covered.get(w, 0) + 1
        j = k if k - j >= least else j + 1
    room = Counter(source)
    return sum(min(n, times * room[w]) for w, n in covered.items())


def is_copy(source: str, response: str, share: float = 0.8) -> bool:
    """Whether the response is the source again, whole or nearly, once or several times."""
    s, r = _WORDS.findall(source.lower()), _WORDS.findall(response.lower())
    if not s or not r:
        return False
    if s == r:
        return True
    known = set(s)
    if sum(w in known for w in r) < share * len(r):
        return False
    if len(s) < 3:
        return "".join(r) == "".join(s) * max(1, round(len(r) / len(s)))
    reps = max(1, round(len(r) / len(s)))
    cover = tiles(s * reps, r) if len(r) * reps < LONG_PAIR else runs(s, r, reps)
    return cover >= share * len(r) and cover >= 0.6 * len(s)


def language_share(text: str, wanted: str) -> float | None:
    """Share of a text that is in the wanted language; None where nothing tells.

    A language in Latin script without function words here is not told from others.
    """
    script = SCRIPT_OF.get(wanted, "latin")
    if script == "latin" and wanted not in FUNCTION_WORDS:
        return None
    plain = plain_words(text)
    words = _WORDS.findall(plain)
    latin, letters = 0, 0
    others = []
    for w in words:
        letters += len(w)
        if w.isascii():
            latin += len(w)
        else:
            others.append(w)
    other = "".join(others)
    counts = {"latin": latin + len(_SCRIPTS["latin"].sub("", other)), "han": len(_SCRIPTS["han"].sub("", other)) if other else 0}
    if sum(counts.values()) < 0.6 * letters or script not in counts:
        counts |= {k: len(p.sub("", other)) for k, p in _SCRIPTS.items() if k not in counts}
    if counts["han"] and (kana := len(_SCRIPTS["kana"].sub("", other))) > 0.1 * counts["han"]:
        counts["kana"] = kana + counts.pop("han")
    weight = {k: n * (LETTERS_PER_IDEOGRAPH if k == "han" else 1.8 if k in ("kana", "hangul") else 1) for k, n in counts.items()}
    total = sum(weight.values())
    if total < 4:
        return None
    share = weight.get(script, 0) / total
    if script != "latin" or share < 0.5:
        return share
    good = bad = 0
    for sentence in re.split(r"[.!?…]\s+|\n+", plain):
        votes: dict[str, int] = {}
        words = _WORDS.findall(sentence.lower())
        for w in words:
            for lang in _OF_WORD.get(w, ()):
                votes[lang] = votes.get(lang, 0) + 1
        if votes:
            top = max(votes.values())
            if top >= 2 or len(words) < 4:
                if votes.get(wanted, 0) == top:
                    good += len(sentence)
                else:
                    bad += len(sentence)
    return share if good + bad < 12 else share * good / (good + bad)


def open_at_end(text: str) -> list[str]:
    """Pushdown parse of brackets, quotations, fences and paired markup: what is still open at the end."""
    stack: list[str] = []
    awaited: Counter = Counter()

    def pop(is_opener: Callable[[str], bool]) -> None:
        while True:
            x = stack.pop()
            awaited[_PAIRS.get(x) or ("</" + x[1:] if x[0] == "<" else "\\end" + x[1:])] -= 1
            if is_opener(x):
                return

    for m in re.finditer(r"```|</?(?:p|ul|ol|li|b|i|em|strong|blockquote|code|a|span|h[1-6]|table|tr|td)\b[^<>]*>|\\(?:begin|end)\{\w+\*?\}|[()（）\[\]【】《》“”„«»「」『』{}]", text):
        t = m.group()
        if t == "```":
            if stack and stack[-1] == "```":
                stack.pop()
            else:
                stack.append("```")
        elif t[0] == "<":
            name = re.match(r"</?(\w+)", t)[1].lower()
            name = "h" if name[0] == "h" and name[1:].isdigit() else name
            if t[1] == "/":
                if awaited[f"</{name}>"]:
                    pop(lambda x: x == f"<{name}>")
            elif not t.endswith("/>"):
                stack.append(f"<{name}>")
                awaited[f"</{name}>"] += 1
        elif t[0] == "\\":
            if t[1] == "b":
                stack.append("\\" + t[6:])
                awaited["\\end" + t[6:]] += 1
            elif awaited[t]:
                pop(lambda x: x == "\\" + t[4:])
        elif t in _CLOSERS and awaited[t]:
            pop(lambda x: _PAIRS.get(x) == t)
        elif t in _PAIRS:
            stack.append(t)
            awaited[_PAIRS[t]] += 1
    return stack


def ends_inside(text: str) -> bool:
    """Whether a text stops inside a sentence: words after the last sentence end."""
    bare = re.sub(r"\s*(?:\[\^[^\]]*\])+$", "", text.rstrip())
    bare = re.sub(r"(?s)\{\|.*?\|\}|<!--.*?-->|<img\b[^<>]*>", "", bare).rstrip()
    last, window, near = None, 300, bare
    while last is None:
        # the last sentence end is sought from the end of the text, as far back as it takes
        near = bare[-window:]
        for last in _END.finditer(near):
            pass
        if len(near) == len(bare):
            break
        window *= 4
    tail = near[last.end() if last else 0 :]
    if re.match(r"\d{1,4}$", tail) and last is not None:
        return True
    tail = re.sub(r"[A-Za-z]:\\\S+|\S+_\S+\.\w+|\([^()]*\)|\{[^{}]{0,40}\}", " ", tail)
    tail = re.sub(r"\$[^$]*\$|\\\(.*?\\\)|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?|\{\{[^{}]*\}\}|\[\[[^\]]*\]\]|</?\w[^<>]*>|```[^`]*```|\{\|.*?\|\}|<!--.*?-->|&#?\w+;|``|''|\[[^\]]{0,12}\]|\{[^}]{0,12}\}", " ", tail, flags=re.S)
    tokens = [t.strip(",;:–—-()（）“”\"'*_") for t in tail.split()]
    signs = sum(1 for t in tail.split() if not re.search(r"[^\W\d_]", t))
    if tokens and signs > 0.25 * len(tokens) and not re.search(r"[㐀-鿿]", tail):
        return False
    return any(re.fullmatch(r"[^\W\d_]+(?:['’][^\W\d_]+)*", t) or re.search(r"[㐀-鿿]", t) for t in tokens if t) or bool(re.search(r"\d+年?$|[,;，；：、]$", tail.strip()) and last is None)


def is_truncated(source: str, response: str, ratio: float | None) -> bool:
    """Whether a response stops before the end of what the source says; ratio: its length against the expected one."""
    sentence = bool(_END.search(_NO_END.sub(" ", source)))
    if ratio is not None and ratio < 0.62:
        # running lines and residue in a short source can make up half of it
        said = len(_END.findall(_NO_END.sub(" ", source))) > len(_END.findall(response))
        if ratio < (0.35 if len(source) < 250 else 0.5 if len(source) < 500 else 0.62) and (said or ratio < 0.35):
            return True
    if not sentence:
        return ratio is not None and ratio < 0.55
    opened = open_at_end(response)
    if opened and len(opened) > len(open_at_end(source)) and opened[-1] not in ("<p>", "<li>", "{", "["):
        return True
    return ends_inside(response)


def defect_of(source: str | None, response: str | None, wanted: str | None, ratio: float | None) -> str | None:
    """The defect of one pair, or None."""
    wordy = source is not None and has_words(source)
    if is_empty(response):
        return "empty" if wordy or source is None or response is None or not response.strip() else None
    if refuses(source, response):
        return "refusal"
    if not wordy:
        return None
    if is_copy(source, response):
        return "copy"
    share = language_share(response, wanted.lower().split("-")[0]) if wanted else None
    if share is not None and share < 0.5:
        return "wrong_language"
    return "truncated" if is_truncated(source, response, ratio) else None


def pair_defects(
    pairs: DataFrame, source_col: str = "source_text", response_col: str = "translated_text", wanted: Column | str = "target_lang", source_lang: Column | None = None
) -> DataFrame:
    """pairs with the column defect: empty, truncated, refusal, copy, wrong_language or null.

    Null sources have only empty responses and refusals as defects; a null wanted
    language leaves the language untested. Repeated rows are judged alike. The
    expected length of a response is the source's length times the median ratio of
    its language pair; pairs of fewer than twenty rows go without that test.
    """
    want = F.col(wanted) if isinstance(wanted, str) else wanted
    rows = pairs.withColumn("_want", want).withColumn("_from", source_lang if source_lang is not None else F.lit("?"))
    size = F.length(F.regexp_replace(F.col(response_col), r"\s+", "")) / F.greatest(F.length(F.regexp_replace(F.col(source_col), r"\s+|</?[a-zA-Z][^<>]*>|\[\[(?:File|Category):[^\]\n]*\]\]|\{\{[^{}]*\}\}", "")), F.lit(1))
    usual = rows.groupBy("_want", "_from").agg(
        F.percentile_approx(F.when(F.length(F.col(response_col)) > 8, size), 0.5, 1000).alias("_usual"), F.count("*").alias("_rows")
    )
    met = rows.join(
        F.broadcast(usual.select(F.col("_want").alias("_w"), F.col("_from").alias("_f"), F.when(F.col("_rows") >= 20, F.col("_usual")).alias("_usual"))),
        F.col("_want").eqNullSafe(F.col("_w")) & F.col("_from").eqNullSafe(F.col("_f")),
        "left",
    )

    def judge(s: pd.Series, r: pd.Series, w: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([defect_of(a, b, c, None if d != d or d is None else d) for a, b, c, d in zip(s, r, w, k)], dtype=object)

    out = met.withColumn("defect", F.pandas_udf(judge, StringType())(F.col(source_col), F.col(response_col), F.col("_want"), size / F.col("_usual")))
    return out.drop("_want", "_from", "_w", "_f", "_usual")


def translation_pairs(translations: DataFrame, segments: DataFrame, books: DataFrame) -> DataFrame:
    """origin, record_key, source_text, translated_text, target_lang, lang of every row of the log.

    A record without a known segment keeps a null source and language.
    """
    langs = books.select(F.col("book_id").alias("_book"), "lang", "target_lang").dropDuplicates(["_book"])
    sources = segments.select(F.col("id").alias("_segment"), F.col("book_id").alias("_b"), "source_text")
    return (
        translations.select(F.lit("translations").alias("origin"), F.col("record_no").cast("string").alias("record_key"), "segment_id", "translated_text")
        .join(sources, F.col("segment_id") == F.col("_segment"), "left")
        .join(langs, F.col("_b") == F.col("_book"), "left")
        .select("origin", "record_key", "source_text", "translated_text", "target_lang", "lang")
    )
