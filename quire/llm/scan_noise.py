"""Noise in text from scanned pages: find it and repair the text into readable paragraphs.

Vocabulary: words are counted over all records; those above a share of all words
make a trie. A share bounds its size: no more than 1 / share words can have it,
so it can be broadcast. Misread forms common enough to slip in are taken out again.

Confusions (one character or pair read as another) are the usual ones of recognition
and those learned from the corpus: for each way in which a rare word differs from one
of the most common words, the part of the common words with the letters concerned
that occur so misread. A confusion of the scanner shows in many of them, a chance
likeness in hardly any.

Candidates: a word that is not in the trie is intersected with it by a Levenshtein
automaton that walks the trie and the word together, so all candidates within reach are
found and nothing else is visited. Steps are confusions, or one edit of any kind.
Candidates are ranked by edits, confusions, whether they are among the words beside
the misread one in its record, and by how common they are. Where a single edit alone
leads to a word, the context decides: it counts as misread only if the words before
and after it stand so beside the candidate elsewhere on the pages around.

Page numbers follow the sequence of the book: in collapsed text only the page's own
number counts. Where the text has that very number by chance, words that usually stand
beside numbers, learned from the corpus too, tell it.

Page furniture: the forms of running lines come from header, footer, aside and title
blocks of a stretch of pages and from blocks of one line repeated on its pages. Records
of one book and stretch meet in one group with the forms of that stretch and both beside
it; a record without a page meets all forms of its book of which its text holds the
beginning of a part. An Aho-Corasick automaton over the folded
forms and their halves finds them in lines and in collapsed text alike; a half is
confirmed by aligning the rest of the form. Forms of a few letters, which may be words
of the text, count only as a line of their own. The stretch bounds the group, whatever
the book's size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut, release

#: Usual confusions of recognition, what is read and what stood there.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("|", "l"), ("5", "s"), ("6", "b"), ("9", "g"), ("†", "t"), ("ſ", "s"), ("ï", "i"), ("c", "e"),
    ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("!", "l"), ("8", "B"), ("@", "a"), ("€", "e"), ("3", "e"), ("rri", "m"), ("nn", "m"), ("lc", "k"),
]
BREAK_MARKS = "-¬­‐‑–⁃"
RUNNING_LABELS = ("header", "footer", "aside_text", "doc_title", "paragraph_title")
_MARKS = re.escape(BREAK_MARKS)
#: Letters from which on a form is sought within lines, and of the grams by which forms and texts without a page meet.
LEAST_FORM = 9
#: Letters of the shortest form; shorter lines are numbers and marks.
SHORT_FORM = 3
#: Records without a page in one group, about.
LOOSE_RECORDS = 400
#: Pieces without unknown tokens that a worker remembers; others are looked at again.
PLAIN_PIECES = 500_000
#: Pages of one group; share of all words that makes a word of the vocabulary; how much more common the right word is.
STRETCH, WORD_SHARE, MORE_COMMON = 48, 1e-5, 12
#: Common words from which confusions are learned; how many of them, and which part, must occur so misread.
LEARNED_FROM, LEAST_WORDS, LEAST_PART = 5000, 10, 0.05
#: Part of a word's printings that stand beside a number, from which on the number belongs to the text.
BESIDE_NUMBER = 0.3
_PUNCTUATION = ".,;:!?()[]{}«»‘’“”„\"'…"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_|†!@€]+(?:[|†!@€]+[^\W_|†!@€]+)*(?:['’][^\W_|†!@€]+(?:[|†][^\W_|†!@€]+)*)*[|†]?|[|†][^\W_|†!@€]+")
_BREAK = re.compile(rf"([^\W\d_]+(?:[0-9|†][^\W_]*)*)[{_MARKS}](?:[ \t]*(?:\r?\n|$)[ \t]*|[ \t]+)([^\W\d_][^\s{_MARKS},.;:!?]*)?", re.UNICODE)
_BREAK_SIGN = re.compile(rf"[{_MARKS}](?:\s|$)")
_BREAK_END = re.compile(rf"[^\W\d_][{_MARKS}]\s*$")
_ROMAN = r"(?=[ivxlcdm])(?:m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_NUMBER_LINE = re.compile(rf"^[\W_]*(?:(?:p|pp|page|pag|s|seite|fol|folio|bl|blatt|f|feuillet)\b\.?\s*)?(?:\d{{1,5}}|{_ROMAN})(?:\s*(?:/|of|von|sur)\s*\d{{1,5}})?[\W_]*$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<!\S)\d{1,5}[.*]?(?!\S)")
_LAST_WORD, _FIRST_WORD = re.compile(r"([^\W\d_]+)\.?$"), re.compile(r"[^\W\d_]+")
#: Marks of the counts of words before and after a number.
_BEFORE, _AFTER = "\x01", "\x02"


class Trie:
    """Vocabulary trie with complete retrieval within a bounded number of confusions, or one edit."""

    def __init__(self, words: dict[str, int], confusions: list[tuple[str, str]] = CONFUSIONS):
        self.root: dict = {}
        self.confusions = confusions
        for w, n in words.items():
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = n

    def near(self, word: str, confusions: int = 2, edits: int = 0) -> dict[str, tuple[int, int, int]]:
        """Words within reach: word -> (edits, confusions, count)."""
        out: dict[str, tuple[int, int, int]] = {}
        seen = set()
        stack = [(self.root, 0, "", 0, 0)]
        n = len(word)
        while stack:
            node, i, made, e, c = stack.pop()
            key = (id(node), i, e, c)
            if key in seen:
                continue
            seen.add(key)
            if i == n and "" in node:
                got = (e, c, node[""])
                if made not in out or got[:2] < out[made][:2]:
                    out[made] = got
            if i < n and (nxt := node.get(word[i])) is not None:
                stack.append((nxt, i + 1, made + word[i], e, c))
            if c < confusions:
                for read, stood in self.confusions:
                    if word.startswith(read, i) and (nxt := _follow(node, stood)) is not None:
                        stack.append((nxt, i + len(read), made + stood, e, c + 1))
            if e < edits:
                if i < n:
                    stack.append((node, i + 1, made, e + 1, c))
                # the last edit must lead into the rest of the word, which is looked up and not walked
                last = e + 1 == edits and c >= confusions
                for ch, nxt in node.items():
                    if not ch:
                        continue
                    for k in (i, i + 1) if i < n and ch != word[i] else (i,):
                        if not last or _follow(nxt, word[k:]) is not None:
                            stack.append((nxt, k, made + ch, e + 1, c))
        return out


def _follow(node: dict, word: str) -> dict | None:
    for ch in word:
        node = node.get(ch)
        if node is None:
            return None
    return node


def fold(text: str) -> str:
    """Letters of a text in lower case; a sign read for a letter counts as a lost letter."""
    return "".join(_LETTERS.findall(text.lower()))


def aligned(form: str, text: str, edits: int) -> int:
    """Length of the start of text that form can be read as with at most so many edits; -1 if none can."""
    i, n = 0, min(len(form), len(text))
    while i < n and form[i] == text[i]:
        i += 1
    if i == len(form):
        return i
    if not edits:
        return -1
    for f, t in ((1, 1), (1, 0), (0, 1)):
        if i + t <= len(text):
            k = aligned(form[i + f :], text[i + t :], edits - 1)
            if k >= 0:
                return i + t + k
    return -1


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each token in lower case occurs over all texts; counted per batch before the shuffle.

    Words before and after a number are counted once more, marked as such.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        beside: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = Counter(beside)
            for piece, n in raw.items():
                for w in _TOKEN.findall(piece):
                    words[w] += n
            return pa.RecordBatch.from_pydict({"word": list(words), "n": pa.array(words.values(), pa.int64())})

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    low = t.lower()
                    raw.update(low.split())
                    for m in _NUMBER.finditer(low):
                        if w := _LAST_WORD.search(low[: m.start()].rstrip()[-40:]):
                            beside[_BEFORE + w[1]] += 1
                        if w := _FIRST_WORD.match(low[m.end() : m.end() + 40].lstrip()):
                            beside[_AFTER + w[0]] += 1
            if len(raw) > 200_000:
                yield out()
                raw.clear()
                beside.clear()
        yield out()

    return texts.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learned_confusions(counts: DataFrame, words: dict[str, int]) -> list[tuple[str, str]]:
    """Confusions that the corpus shows: (read, stood), one or two characters each.

    All rare tokens of the corpus are held against the most common words. A pair is
    kept if it leads from rare tokens to at least LEAST_WORDS of these words and to
    LEAST_PART of those that have the letters. What comes to the driver is bounded by
    the places of letters in the common words.
    """
    common = dict(sorted(((w, n) for w, n in words.items() if len(w) >= 4), key=lambda x: (-x[1], x[0]))[:LEARNED_FROM])
    at: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    having: Counter = Counter()
    for w in common:
        spots = {(k, i) for k in (1, 2) for i in range(len(w) - k + 1)}
        having.update({w[i : i + k] for k, i in spots})
        for k, i in spots:
            at[w[:i], w[i + k :]].append((w, w[i : i + k]))
    shipped = counts.sparkSession.sparkContext.broadcast((common, dict(at)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, at = shipped.value
        for b in batches:
            out = set()
            for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in (1, 2):
                    for i in range(len(r) - k + 1):
                        for w, stood in at.get((r[:i], r[i + k :]), ()):
                            read = r[i : i + k]
                            if len(read) + len(stood) < 4 and read[0] != stood[0] and read[-1] != stood[-1] and common[w] >= MORE_COMMON * n:
                                out.add((read, stood, w))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["read", "stood", "word"])

    known = counts.sparkSession.createDataFrame([(w,) for w in words] or [("",)], "word string")
    rare = counts.where((F.length("word") >= 4) & ~F.col("word").rlike(r"^\d+$|^[\x01\x02]")).join(known, "word", "left_anti")
    pairs = rare.mapInArrow(compare, "read string, stood string, word string").distinct().groupBy("read", "stood").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_WORDS)
    return sorted((r.read, r.stood) for r in pairs.collect() if r.n >= LEAST_PART * having[r.stood])


def vocabulary(counts: DataFrame, share: float = WORD_SHARE, least: int = 8) -> tuple[dict[str, int], list[tuple[str, str]], set[str]]:
    """Words of at least a share of all words without misread forms, confusions, and words that stand beside numbers.

    Never more than 1 / share words. In the last, words carry the mark of their side.
    """
    is_word = F.col("word").rlike(r"^[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*$")
    total = counts.where(is_word).agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= max(least, int(total * share)))
    words = {r.word: r.n for r in often.where(is_word).select("word", "n").collect()}
    sides = {r.word for r in often.where(F.col("word").rlike(r"^[\x01\x02]")).select("word", "n").collect() if r.n >= BESIDE_NUMBER * words.get(r.word[1:], r.n)}
    confusions = CONFUSIONS + [x for x in learned_confusions(counts, words) if x not in CONFUSIONS]
    for w in [w for w in words if len(w) > 2]:
        for read, stood in confusions:
            at = w.find(read)
            while at >= 0:
                right = w[:at] + stood + w[at + len(read) :]
                if words.get(right, 0) >= MORE_COMMON * words[w]:
                    words[w] = -1
                    break
                at = w.find(read, at + 1)
    return {w: n for w, n in words.items() if n > 0}, confusions, sides


class Reader:
    """Word-level judgements against one vocabulary; kept by a worker for all its groups."""

    def __init__(self, words: dict[str, int], confusions: list[tuple[str, str]] = CONFUSIONS, beside_numbers: Iterable[str] = ()):
        self.words = words
        self.known: set[str] = set(words) | {w.capitalize() for w in words} | {w.upper() for w in words}
        self.trie = Trie(words, confusions)
        self.beside_numbers = set(beside_numbers)
        self.letters = [(read, stood) for read, stood in confusions if read.isalpha() and stood.isalpha()]
        self.signs = {read: stood for read, stood in reversed(confusions) if len(read) == 1 and not read.isalpha()}
        self.plain: set[str] = set()
        self.candidates = lru_cache(maxsize=200_000)(self._candidates)
        self.edited = lru_cache(maxsize=200_000)(self._edited)

    def right(self, token: str, text: str = "", around: Callable[[], str] | None = None) -> str | None:
        """The word a token was misread from, or None.

        Of equally near words the first that stands in the text beside it; text is the
        record, around gives the text of the pages about it.
        """
        got = self.candidates(token)
        if len(got) > 1 and text:
            beside = set(_WORD.findall(text.lower()))
            return next((w for w in got if w in beside), got[0])
        if got:
            return got[0]
        return self.in_context(token, text, around) if around else None

    def _candidates(self, token: str) -> tuple[str, ...]:
        """The nearest words a token can be misread from by confusions, the most common first."""
        low = token.lower()
        if low in self.words or re.fullmatch(r"\d+|\d+(?:v|r|er|st|nd|rd|th)|[A-Za-z]\d{1,3}|\d+", token):
            return ()
        got = self.trie.near(low, confusions=3 if len(low) > 6 else 2)
        if got and len(low) > 1:
            ranks = sorted(got, key=lambda w: (got[w][1], -got[w][2]))
            best = ranks[0]
            if got[best][1] and len(best) > 1:
                return tuple(w for w in ranks if got[w][1] == got[best][1] and len(w) > 1)
        # a sign between letters of a name: no vocabulary can hold all names
        if re.fullmatch(r"[^\W\d_]+[015689|†!][a-zà-ÿ]+(?:['’]\w+)?|[^\W\d_]{3,}[156|†]", token) and not re.search(r"[A-Z]{2}", token) and (token[0].isupper()):
            return ("".join(self.signs.get(x, x) if i else x for i, x in enumerate(token)),)
        if re.search(r"[a-z]ï[a-z]|^[A-Z]ï[a-z]", token) and low not in self.words:
            return (token.replace("ï", "i"),)
        return ()

    def _edited(self, token: str) -> tuple[str, ...]:
        """The words a token differs from by one edit, the most common first; names and parts of words have none."""
        if len(token) < 5 or not token.isalpha() or not token.islower() or token in self.words:
            return ()
        return tuple(w for w in self.ranked(token, set(), confusions=0) if len(w) >= 4)

    def ranked(self, token: str, beside: set[str], confusions: int = 2) -> list[str]:
        """All candidates within so many confusions and one edit, best first: edits, confusions, words beside, count."""
        got = self.trie.near(token.lower(), confusions, edits=1)
        return sorted(got, key=lambda w: (got[w][0], got[w][1], w not in beside, -got[w][2], w))

    def in_context(self, token: str, text: str, around: Callable[[], str]) -> str | None:
        """The word within one edit of a token that stands elsewhere between the same words as the token does here."""
        got = self.edited(token)
        if not got:
            return None
        pieces = text.lower().split()
        for i, piece in enumerate(pieces):
            if token in piece and piece.strip(_PUNCTUATION) == token:
                before, after = pieces[i - 1] if i else "", pieces[i + 1] if i + 1 < len(pieces) else ""
                near = around()
                for w in got:
                    there = piece.replace(token, w, 1)
                    if (before or after) and (not before or f" {before} {there} " in near) and (not after or f" {there} {after} " in near):
                        return w
                return None
        return None

    def broken(self, first: str, second: str) -> bool:
        """Whether two fragments around a break mark are one word."""
        a, b = first.lower(), second.lower()
        if not b or a + b in self.words or self.right(first + second):
            return True
        if second[0].isupper() and not first.isupper():
            return False
        return b not in ("and", "und", "et", "or", "oder", "ou", "bis", "to")


def running_forms(lines: list[tuple[str, int, str]]) -> set[str]:
    """Folded forms of the running lines of a stretch of pages; lines: text, page, label."""
    forms: set[str] = set()
    alone: set[str] = set()
    pages: dict[str, set[int]] = defaultdict(set)
    for line, page, label in lines:
        f = fold(line)
        if len(f) < SHORT_FORM:
            continue
        if label in RUNNING_LABELS:
            forms.add(f)
        elif label == "alone":
            alone.add(f)
        pages[f].add(page)
    total = len({p for s in pages.values() for p in s}) or 1
    # a sentence's beginning may fill a line on many pages, but never a block of its own
    return forms | {f for f in alone if len(pages[f]) >= max(4, total / 7)}


class Furniture:
    """Running lines by their folded forms."""

    def __init__(self, forms: Iterable[str]):
        import ahocorasick

        forms = set(forms)
        self.short = {f for f in forms if len(f) < LEAST_FORM}
        self.forms = forms - self.short
        self.auto = ahocorasick.Automaton() if self.forms else None
        parts: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for f in self.forms:
            parts[f].append((f, 0))
            if len(f) >= 20:
                h = len(f) // 2
                parts[f[:h]].append((f, 0))
                parts[f[h:]].append((f, h))
        for p, of in parts.items():
            self.auto.add_word(p, (p, of))
        if self.auto:
            self.auto.make_automaton()

    def _lines(self, text: str) -> list[tuple[int, int]]:
        """Spans of lines that are a form of few letters."""
        out, at = [], 0
        for line in text.split("\n"):
            if len(line) < 40 and fold(line) in self.short:
                out.append((at, at + len(line.rstrip("\r"))))
            at += len(line) + 1
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of running lines in a text."""
        alone = self._lines(text) if self.short else []
        if not self.auto:
            return alone
        low = text.lower()
        if len(low) != len(text):
            low = text
        folded = "".join(_LETTERS.findall(low))
        spans = set()
        for end, (part, of) in self.auto.iter(folded):
            start = end - len(part) + 1
            for form, offset in of:
                if part == form:
                    spans.add((start, end + 1))
                elif offset == 0:
                    rest = form[len(part) :]
                    k = aligned(rest, folded[end + 1 : end + 3 + len(rest)], 2)
                    if k >= 0:
                        spans.add((start, end + 1 + k))
                else:
                    rest = form[:offset][::-1]
                    k = aligned(rest, folded[max(0, start - offset - 2) : start][::-1], 2)
                    if k >= 0:
                        spans.add((start - k, end + 1))
        if not spans:
            return alone
        # where the letters stand: runs of them by their place in the folded text
        starts, places, n = [], [], 0
        for m in _LETTERS.finditer(low):
            starts.append(n)
            places.append(m.start())
            n += m.end() - m.start()

        def place(k: int) -> int:
            i = bisect_right(starts, k) - 1
            return places[i] + k - starts[i]

        out = [(place(a), place(b - 1) + 1) for a, b in spans if b > a] + alone
        out.sort()
        merged: list[tuple[int, int]] = []
        for a, b in out:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


#: Signs between a running line and a number attached to it.
_BESIDE = " \t|·–—-[].,;:©*"
_SIGNS_BESIDE = " \t|·©–—-"


def roman(n: int) -> str:
    """A number in lower-case roman numerals."""
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def page_spans(text: str, page: int | None, offset: int, running: list[tuple[int, int]], note: bool, beside_numbers: Iterable[str] = ()) -> list[tuple[int, int]]:
    """Spans of page numbers: lines of their own, or, where line breaks are gone, the page's own number between words."""
    out = []
    if "\n" in text or len(text) < 14:
        at = 0
        for line in text.split("\n"):
            if line.strip() and _NUMBER_LINE.match(line.strip()):
                out.append((at, at + len(line)))
            at += len(line) + 1
    if page is not None and "\n" not in text and len(text) >= 4:
        n = page + offset
        if n < 1 or str(n) not in text and roman(n) not in text:
            return out
        pattern = rf"(?<![^\s])(?:[-–—] {n} [-–—]|\[{n}\]|(?:p\.|Page|page|S\.|Seite) ?{n}|{n}[.*]?|{roman(n)})(?=\s|$)"
        own = []
        for m in re.finditer(pattern, text):
            before, after = text[: m.start()].rstrip(), text[m.end() :].lstrip()
            loose = m.group().strip("[]").isalnum()
            if loose and any(a - 6 <= m.end() and m.start() <= b + 6 and not text[b : m.start()].strip(_BESIDE) and not text[m.end() : a].strip(_BESIDE) for a, b in running):
                continue
            if note and m.start() == 0 or after[:5] == "[sic]" or before and before[-1] in ",(*=<>#~$|^&" or after and after[0] in "*=<>|^%)":
                continue
            last, first = _LAST_WORD.search(before[-40:]), _FIRST_WORD.match(after)
            bare = m.group()[0].isdigit()
            if bare and (first and _AFTER + first.group().lower() in beside_numbers or last and _BEFORE + last.group(1).lower() in beside_numbers):
                continue
            if m.group() in ("i", "I", "c", "d", "l", "m", "v", "x") and before and after and n != 1:
                continue
            own.append(m)
        # a page prints its number once: beside one with marks, bare ones belong to the text
        marked = [m for m in own if not m.group().rstrip(".*").isalnum()]
        out += [m.span() for m in marked or own]
    return out


def unknown_tokens(text: str, reader: Reader) -> set[str]:
    """Tokens of a text that the vocabulary does not hold; pieces between blanks that hold none are remembered."""
    out: set[str] = set()
    for piece in set(text.split()) - reader.plain:
        odd = set(_TOKEN.findall(piece)) - reader.known
        if odd:
            out |= odd
        elif len(reader.plain) < PLAIN_PIECES:
            reader.plain.add(piece)
    return out


def _breaks(text: str) -> Iterator[re.Match]:
    """What _BREAK finds in a text, looked for only at the words before a mark and a blank."""
    done = 0
    for sign in _BREAK_SIGN.finditer(text):
        at = sign.start()
        word = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
        if at >= done and (m := _BREAK.search(text, max(word, done))) and m.end(1) == at:
            done = m.end()
            yield m


def judge(text: str, page: int | None, offset: int, kind: str, reader: Reader, furniture: Furniture, names: Counter, tokens: set[str], around: Callable[[], str] | None = None) -> dict:
    """Spans and words of the noise in one record.

    tokens: its unknown tokens, names: in how many records of the group each stands,
    around: gives the text of the group.
    """
    running = furniture.spans(text) if kind not in ("heading", "table") else []
    numbers = page_spans(text, page, offset, running, kind == "footnote", reader.beside_numbers) if kind not in ("heading", "caption") else []
    body = without_furniture(text, running + numbers, None if page is None else page + offset) if running or numbers else text
    breaks, fragments = [], set()
    if _BREAK_SIGN.search(body):
        lined = "\n" in text
        for m in _breaks(body):
            first, second = m.group(1), m.group(2) or ""
            if not second and body[m.end() :].strip() and not re.match(r"\s*[\W\d]", body[m.end() :]):
                continue
            newline = "\n" in m.group() or not second
            if not newline and lined and first.lower() + second.lower() not in reader.words:
                continue
            if reader.broken(first, second):
                breaks.append(m.group())
                fragments |= {first, second}
        if not breaks and _BREAK_END.search(body):
            breaks.append(body.rstrip()[-1])
    misread = {}
    if running and tokens:
        # what is misread in a running line goes with the line
        tokens = tokens & set(_TOKEN.findall(body))
    for t in tokens:
        if t in fragments or len(t) < 2:
            continue
        w = reader.right(t, text, around)
        if not w and t[0].isupper() and t[1:].islower() and t.isalpha():
            # a name: another one, far more common here, that a confusion leads to
            more = max(3, 3 * names.get(t, 1))
            for read, stood in reader.letters:
                k = t.find(read, 1)
                while k > 0 and not w:
                    other = t[:k] + stood + t[k + len(read) :]
                    if names.get(other, 0) >= more:
                        w = other
                    k = t.find(read, k + 1)
        if w:
            misread[t] = w
    for m in breaks:
        joined = re.sub(rf"[{_MARKS}]\s*", "", m)
        if joined not in reader.known and (w := reader.right(joined, text)):
            misread[joined] = w
    return {"running": running, "numbers": numbers, "breaks": breaks, "misread": misread, "page": None if page is None else page + offset}


def without_furniture(text: str, spans: list[tuple[int, int]], page: int | None) -> str:
    """A text without running lines and page numbers, and without the page's own number attached to them."""
    number = rf"(?:\[?{page}\]?)?" if page else ""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        # the page's own number and signs beside a running line go with it, other numbers are text
        left = _without_number(text[at:a], page)
        # a mark that breaks a word stays
        if left[-1:].isalpha() and at + len(left) < a and text[at + len(left)] in BREAK_MARKS:
            left += text[at + len(left)]
        out.append(left)
        after = re.match(rf"[.,*]?[ \t|·–—-]*{number}\s*", text[b:])
        at = b + after.end()
        out.append("\n" if "\n" in text else " ")
    out.append(text[at:])
    return "".join(out)


def _without_number(left: str, page: int | None) -> str:
    """What stands before a running line, without the page's own number and signs at its end."""
    r = left.rstrip(_SIGNS_BESIDE)
    for number in (f"[{page}]", str(page)) if page else ():
        if r.endswith(number) and not r[: -len(number)][-1:].isdigit():
            r = r[: -len(number)].rstrip()
            break
    r = r.rstrip()
    return r[:-1].rstrip() if r[-1:] and r[-1] in "|·–—-" else r


def reflow(text: str, found: dict, reader: Reader, rows: bool = False) -> str:
    """The text without furniture, words joined and corrected, lines run together into paragraphs; rows: each line is a table's row and stays one."""
    t = without_furniture(text, found["running"] + found["numbers"], found["page"])
    t = _BREAK.sub(lambda m: m[1] + (m[2] or "") if m[2] and reader.broken(m[1], m[2]) else m[0], t)
    for bad, good in found["misread"].items():
        right = good.capitalize() if bad[:1].isupper() else good
        t = re.sub(rf"(?<!\w){re.escape(bad)}(?!\w)", right, t)
    if rows:
        return "\n".join(x for line in t.splitlines() if (x := re.sub(r"\s+", " ", line).strip()))
    paragraphs = re.split(r"\r?\n\s*\r?\n", t)
    return "\n\n".join(x for p in paragraphs if (x := re.sub(r"\s+", " ", p).strip()))


def _forms_told(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(book, stretch, form): the running lines that each group is told.

    A stretch of pages is told its own and those of both beside it. A group of records
    without a page is told those of the whole book that can stand in its texts: a form
    or a half of one is found only where its first letters are, so they meet by grams.
    """

    def group(t: pa.Table) -> pa.Table:
        lines = []
        for page, kind, text in zip(*(t.column(c).to_pylist() for c in ("page", "kind", "text"))):
            several = text.splitlines()
            lines += [(x, page, "alone" if len(several) == 1 and kind not in RUNNING_LABELS else kind) for x in several if x]
        forms = sorted(running_forms(lines))
        rows = pa.array([0] * len(forms), pa.int32())
        return pa.table([t.column("book").take(rows), t.column("stretch").take(rows), pa.array(forms, pa.string())], ["book", "stretch", "form"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                low = text.lower()
                folded = "".join(_LETTERS.findall(low if len(low) == len(text) else text))
                own = {folded[k : k + LEAST_FORM] for k in range(len(folded) - LEAST_FORM + 1)}
                own |= {f for line in text.split("\n") if len(line) < 40 and SHORT_FORM <= len(f := fold(line)) < LEAST_FORM}
                at += [i] * len(own)
                out += own
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out, pa.string())], ["book", "stretch", "gram"])

    printed = blocks.where(F.col("page").isNotNull() & F.col("text").isNotNull() & (F.coalesce("kind", F.lit("")) != "number") & F.col("book").isNotNull())
    forms = cut(printed.groupBy("book", "stretch").applyInArrow(group, "book string, stretch long, form string"))
    near = forms.withColumn("stretch", F.explode(F.array(F.col("stretch") - 1, "stretch", F.col("stretch") + 1))).where("stretch >= 0")
    half = F.floor(F.length("form") / 2).cast("int")
    starts = F.when(F.length("form") >= 20, F.array(F.left("form", F.lit(LEAST_FORM)), F.substring("form", half + 1, F.lit(LEAST_FORM)))).otherwise(F.array(F.left("form", F.lit(LEAST_FORM))))
    known = forms.select("book", "form").distinct().select("book", "form", F.explode(starts).alias("gram"))
    loose = rows.where(F.col("page").isNull() & F.col("text").isNotNull() & ~F.coalesce("kind", F.lit("")).isin("heading", "table")).select("book", "stretch", "text")
    met = loose.mapInArrow(grams, "book string, stretch long, gram string").join(known, ["book", "gram"]).select("book", "stretch", "form")
    return near.unionByName(met).distinct()


def scan_noise(
    blocks: DataFrame,
    segments: DataFrame | None,
    book: str = "book_id",
    with_text: bool = False,
    stretch: int = STRETCH,
) -> DataFrame:
    """origin, record_key, noise (array of hyphen_break, misread, running_line, page_number), and clean_text if wanted.

    One row per text block and per segment of a book that has blocks; the other
    blocks only tell the running lines. Null and empty texts have no noise and stay
    as they are; repeated rows of a record count once; rows without a key are
    left out; rows without a page are told the running lines of their whole book, but
    not the names beside them. An empty table gives an empty result; other columns are
    not looked at.
    """
    spark = blocks.sparkSession
    b = blocks.where(F.col("id").isNotNull()).select(
        F.lit("blocks").alias("origin"), F.col("id").alias("record_key"), F.col(book).alias("book"), F.col("page_index").cast("int").alias("page"), F.col("label").alias("kind"), F.col("content").alias("text")
    )
    rows = b
    if segments is not None:
        scanned = blocks.select(F.col(book).alias("book")).distinct()
        s = segments.where(F.col("id").isNotNull()).select(
            F.lit("segments").alias("origin"), F.col("id").alias("record_key"), F.col(book).alias("book"), F.col("page_json").cast("int").alias("page"), F.col("kind"), F.col("source_text").alias("text")
        )
        rows = b.unionByName(s.join(scanned, "book", "left_semi"))
    counts = cut(word_counts(rows.where("origin = 'segments' or kind = 'text'"), "text"))
    shipped = spark.sparkContext.broadcast(vocabulary(counts))
    release(counts)
    loose = rows.where(F.col("page").isNull()).groupBy(F.col("book").alias("_book")).agg(F.ceil(F.count("*") / LOOSE_RECORDS).alias("_parts"))
    bucket = F.coalesce(F.floor(F.col("page") / stretch), -F.pmod(F.xxhash64("record_key"), F.col("_parts")) - 1)
    schema = "origin string, record_key string, noise array<string>" + (", clean_text string" if with_text else "")

    def group(t: pa.Table) -> pa.Table:
        reader = _reader(shipped)
        offsets, names, forms, once = Counter(), Counter(), [], {}
        for origin, key, page, kind, text in zip(*(t.column(c).to_pylist() for c in ("origin", "record_key", "page", "kind", "text"))):
            if origin == "forms":
                forms.append(text)
            elif origin == "segments" or kind == "text":
                once.setdefault((origin, key), (page, kind, text))
            elif page is not None and text and (m := re.search(r"\d+", text)):
                offsets[int(m.group()) - page] += 1
        offset = max(offsets, key=lambda o: (offsets[o], -abs(o), o), default=1)
        furniture = Furniture(forms)
        odd = [unknown_tokens(text, reader) if text else set() for _, _, text in once.values()]
        around = cache(lambda: f" {' '.join(' '.join(text.lower().split()) for _, _, text in once.values() if text)} ")
        for tokens in odd:
            names.update(tokens)
        noises, texts = [], []
        for tokens, (page, kind, text) in zip(odd, once.values()):
            if not text:
                noises.append([])
                texts.append(text)
                continue
            found = judge(text, page, offset, kind or "", reader, furniture, names, tokens, around)
            noises.append([n for n, k in (("hyphen_break", "breaks"), ("misread", "misread"), ("running_line", "running"), ("page_number", "numbers")) if found[k]])
            texts.append(reflow(text, found, reader, kind == "table") if with_text else text)
        cols = [pa.array([o for o, _ in once], pa.string()), pa.array([k for _, k in once], pa.string()), pa.array(noises, pa.list_(pa.string()))]
        return pa.table(cols + [pa.array(texts, pa.string())] * with_text, ["origin", "record_key", "noise", "clean_text"][: 3 + with_text])

    placed = rows.join(loose, F.col("book").eqNullSafe(F.col("_book")), "left").withColumn("stretch", bucket).drop("_book", "_parts")
    told = _forms_told(b.withColumn("stretch", F.floor(F.col("page") / stretch)), placed.where("origin = 'segments' or kind = 'text'"))
    forms = told.select(F.lit("forms").alias("origin"), F.col("form").alias("record_key"), "book", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("kind"), F.col("form").alias("text"), "stretch")
    judged = placed.where("origin = 'segments' or kind in ('text', 'number')")
    return judged.unionByName(forms).groupBy("book", "stretch").applyInArrow(group, schema)


_readers: dict[int, Reader] = {}


def _reader(shipped) -> Reader:
    key = id(shipped)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(*shipped.value)
    return _readers[key]
