"""Personal information in free text: a skip-chain conditional random field over candidate segments.

Candidate segments (anything shaped like an address, a number, a mail address, a person's name, or a word of
such a name standing alone elsewhere in the document) are the nodes; everything else is certain to be outside.
A node's local potential is a log-linear model over its words, shape and neighbouring words. Chain edges join
neighbours in the text, skip edges join distant nodes with the same or a similar token (a surname in another
letter case, with other accents or a genitive s, a given name, a number), with one potential for each pair of
labels, fitted by pseudo-likelihood, so that labels agree across a document: a surname on its own is known by
the full name elsewhere. Labels come from loopy sum-product message passing over all documents of a batch at
once. Skip messages are divided by a node's degree; messages are therefore bounded, and nodes that no message
could lift are left out beforehand.

There are no labelled documents: the model is fitted on at most ``TRAIN_DOCS`` documents (those with the
least hash of their id) to labels of cue patterns, such as a name whose letters stand in the mail address
beside it. Its size is bounded by ``1 << HASH_BITS`` weights. Everything else reads all documents whole.

Not covered: names in small letters, the third word of a name, names in Han or kana, Korean names other than
three syllables, and streets whose kind is not among the words below.

Defined cases: a null text gives no finding and stays null; an empty text stays empty; a finding that
stands several times is reported once per document, and every place is replaced; overlapping findings go
to the likelier one, then the longer, then the earlier; a part of a name on its own is replaced as a name but
is no full name, so its kind is ``name_part`` and ``found_rows`` leaves it out; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import least_hashed

LABELS = ["O", "email", "phone", "id_number", "address", "name"]
K = len(LABELS)
TRAIN_DOCS = 3_000
HASH_BITS = 18
ROUNDS = 5
#: Distance in characters up to which two neighbours share a chain edge, and the bounds of a chain's and a skip edge's potential.
NEAR, EDGE, SKIP = 60, 1.5, 4.0
#: What a skip edge adds to equal labels before the fit.
AGREE = 2.0

#: Capitals of the Latin, Greek and Cyrillic alphabets.
UP = "A-ZÀ-ÖØ-Þ" + "".join(c for c in map(chr, [*range(0x100, 0x250), *range(0x370, 0x430)]) if c.isupper())
LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*( ?)$")
DOT = r"(?: ?(?:\[dot\]|\(dot\)|(?<= )dot(?= )) ?|\.)"
DOMAIN = re.compile(rf" ?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}}(?!\w)", re.I)
# patterns start with a set of characters, which the engine finds fast; what stands before is looked at afterwards
NUMBER = re.compile(r"\d(?:[ ().\-]{0,3}\d){5,17}(?:-?[A-Z](?!\w)|(?<=\d\d) [A-Z](?!\w))?(?!\w|\.\d|-\d)")
LETTERS = re.compile(r"(?:^|[^\w.\-/+＠@])(?!ID|NO|NR|N |V |C )([A-Z]{1,2} ?)$")
# words that make a street, by language
STREET_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Close|Crescent|Highway|Parkway"
STREET_FR = "rue|avenue|av|boulevard|bd|impasse|chemin|place|allée|quai|cours|route|passage|square"
STREET_DE = "straße|strasse|str\\.|weg|platz|allee|gasse|ring|ufer|damm|steig|pfad|hof"
STREET_ES = "Calle|C/|Avenida|Avda\\.|Av\\.|Plaza|Pza\\.|Paseo|Pº|Camino|Carretera|Ronda|Travesía|Rua|R\\.|Praça|Via|Viale|Corso|Piazza|ul\\.|al\\."
UNIT = "(?:,? (?:Apt|Apartment|Unit|Suite|Ste|Flat|No)\\.? ?\\d+[A-Za-z]?|, #\\d+)?"
ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]? (?:[{UP}][\w'’-]+ ){{1,3}}(?:(?:Ave|St|Rd|Ln|Ct|Dr|Blvd|Pl|Sq)\.|(?:{STREET_EN})(?!\w)){UNIT}"
    rf"|(?<![\w.,-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{STREET_FR})\.? (?:(?:de la|de l['’]|de|du|des|d['’]) ?)?[{UP}][\w'’-]+(?: [{UP}][\w'’-]+)?(?:,? (?:appt?\.?|bât\.?|étage) ?\w+)?"
    rf"|(?<!\w)[{UP}][\w'’-]*(?:{STREET_DE}) \d{{1,4}}[a-z]?(?!\w)(?:, (?:Wohnung|Whg\.|App\.) ?\d+)?|(?<!\w)[{UP}][\w'’-]+ (?:Straße|Str\.|Weg|Platz|Allee|Gasse) \d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)(?:{STREET_ES}) ?(?:(?:de la|de los|del|de|da|do) )?[{UP}][\w'’-]+(?: [{UP}][\w'’-]+)?(?:,| n\.?º| nº| núm\.)? ?\d{{1,4}}[a-z]?(?!\w)(?:, ?\d+\.?º ?\w?)?"
    r"|(?<![가-힣])[가-힣]{2,8}(?:대로|로|길) ?\d{1,4}(?:번길 ?\d{1,4}|번지)?(?:-\d+)?(?![\d번])(?:, ?\d+동 ?\d+호|, ?\d+호|, ?\d+층)?"
)
STREET_HINTS = [
    *(f" {w}" for w in STREET_EN.split("|") if w not in ("St", "Ave", "Dr", "Pl", "Sq")), " St", " Ave", " Dr", " Pl", " Sq",
    *(f"{w} " for w in STREET_FR.split("|")), *STREET_DE.replace("\\", "").split("|"), *STREET_ES.replace("\\", "").split("|"),
    "Straße", "Str.", "Weg ", "Platz ", "Allee ", "Gasse ",
]
KO_STREET = re.compile(r"[로길] ?\d")
def _marks() -> ahocorasick.Automaton:
    """One pass over a text finds the words of streets and the signs of mail addresses: length back to the start, and length of a sign (0: a street)."""
    out = ahocorasick.Automaton()
    for w in STREET_HINTS:
        out.add_word(w, (len(w) - 1, 0))
    for at in ("at", "At", "AT", "aT"):
        for w in (f"[{at}]", f"({at})"):
            out.add_word(w, (3, 4))
        out.add_word(f" {at} ", (2, 2))  # the blanks are no part of it
    for at in "@＠":
        out.add_word(at, (0, 1))
    out.make_automaton()
    return out


_MARKS = _marks()
NAME = re.compile(rf"([{UP}][\w'’-]+)(, | )(?:([A-Z]\.) )?(?=([{UP}][\w'’-]+)( [A-Z]\.(?! ?[{UP}]\w))?)")
SURNAME = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용"
NAME_KO = re.compile(rf"([{SURNAME}])(?<![가-힣].)([가-힣]{{2}})(?=[씨님]|\W|$)")
TITLE = {"ms", "mr", "mrs", "dr", "prof", "sr", "sra", "herr", "frau", "mme", "mlle", "m", "sig", "dott", "don", "doña", "sir", "madam"}

# words that stand before a number of a kind, and after a Korean name
CUE_PHONE = {"tel", "tel.", "phone", "call", "fallback", "unter", "au", "el", "연락처는", "reached", "telefon", "mobile", "fax", "전화", "씨가", "과장", "at"}
CUE_ID = {"id", "number", "ausweisnummer", "numéro", "documento", "list", "주민번호", "passport", "nif", "dni", "ssn", "등록번호", "여권번호", "steuernummer"}
CUE_NONE = {"no", "no.", "ticket", "part", "firmware", "host", "batch", "build", "model", "eur", "size", "version", "order", "row", "line", "range", "serial", "usd", "v"}
NO_NAME = TITLE | CUE_PHONE | CUE_ID | CUE_NONE | {"apt", "st", "ave"}
KO_AFTER = ("님", "씨", "과장", "대리", "부장", "팀장", "차장", "사원", "주임")
KO_BEFORE = {"담당", "등록", "사람", "담당자", "검수자", "수신", "발신"}

# read backwards from the segment: up to three marks, then a word
_BEFORE = re.compile(r"(\W{0,3}?)(\.?[^\W\d_]+(?!\w)|\w+)|(\W{0,3})")
_HANGUL = re.compile("[가-힣]")
_AFTER = re.compile(r"^(\W{0,3})([^\W\d_]+)?")


@lru_cache(maxsize=50_000)
def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if c.isalnum() and not unicodedata.combining(c))


def _around(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    b = _BEFORE.match(text[max(0, start - 24) : start][::-1])
    a = _AFTER.match(text[end : end + 20])
    if b[2]:
        return b[2][::-1].lower(), b[1][::-1], a[1], (a[2] or "").lower()
    return "", b[3][::-1], a[1], (a[2] or "").lower()


@lru_cache(maxsize=100_000)
def _h(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode()) & ((1 << HASH_BITS) - 1)


class Candidate:
    """A segment: place, group (which labels it may have), features by hash, tokens for skip edges."""

    __slots__ = ("start", "end", "group", "features", "tokens", "weak", "pair", "score")

    def __init__(self, start, end, group, features, tokens, weak, pair=None, score=0.0):
        self.start, self.end, self.group, self.features, self.tokens, self.weak, self.pair, self.score = start, end, group, features, tokens, weak, pair, score


#: The labels each group may have beside O.
GROUPS = {"email": [1], "number": [2, 3], "address": [4], "name": [5], "name_ko": [5], "part": [5]}


def _stem(folded: str) -> str:
    """Similar tokens share it: a genitive or plural s goes."""
    return folded[:-1] if len(folded) > 4 and folded[-1] == "s" else folded


@lru_cache(maxsize=100_000)
def token_features(role: str, w: str) -> tuple[int, ...]:
    shape = "U" if w.isupper() else "C"
    low = w.lower()
    return _h(role, "w", low), _h(role, "s3", low[-3:]), _h(role, "s4", low[-4:]), _h(role, "s5", low[-5:]), _h(role, "sh", shape), _h(role, "len", str(min(len(w), 14)))


def name_candidates(text: str, model: Model | None) -> Iterator[Candidate]:
    score = model.token_score if model else None
    for m in NAME.finditer(text):
        first, sep, initial, last, after_initial = m.groups()
        if m.start() and (text[m.start() - 1] in "@＠./-_" or text[m.start() - 1].isalnum()):
            continue
        if first.lower() in NO_NAME or last.lower() in NO_NAME:
            continue
        if sep == ", ":
            initial = None
            if m[3]:
                continue
        else:
            after_initial = None
        given, family = (last, first) if sep == ", " else (first, last)
        own = score("g", given) + score("f", family) if score is not None else 0.0
        if score is not None and own < model.floor:
            continue
        start, end = m.start(1), m.end() + len(last) + len(after_initial or "")
        bw, bp, ap, aw = _around(text, start, end)
        form = ("L" if sep == ", " else "F") + ("i" if initial or after_initial else "")
        mixed = ("U" if given.isupper() else "C") + ("U" if family.isupper() else "C")
        features = [*token_features("g", given), *token_features("f", family), _h("form", form), _h("mix", mixed), _h("bw", bw), _h("bp", bp[-2:]), _h("ap", ap[:2]), _h("aw", aw), _h("bias")]
        yield Candidate(start, end, "name", features, (_stem(_fold(family)), _stem(_fold(given))), None, (given, family, bw, aw), own)


def ko_candidates(text: str) -> Iterator[Candidate]:
    for m in NAME_KO.finditer(text):
        bw, bp, ap, aw = _around(text, m.start(), m.end())
        next2 = text[m.end() : m.end() + 3].strip()[:2]
        features = [_h("kw", m[0]), _h("ks", m[1]), _h("k1", m[2][0]), _h("k2", m[2][1]), _h("kbw", bw), _h("kn", next2), _h("kap", ap[:2]), _h("kaw", aw[:2]), _h("kbias")]
        cue = bw in KO_BEFORE or text[m.end() : m.end() + 4].strip().startswith(KO_AFTER)
        yield Candidate(m.start(), m.end(), "name_ko", features, (m[0],), 5 if cue else 0)


def number_candidates(text: str) -> Iterator[Candidate]:
    for m in NUMBER.finditer(text):
        start, end = m.start(), m.end()
        before = text[start - 1] if start else " "
        letters = LETTERS.search(text[max(0, start - 4) : start]) if before.isalpha() or before == " " else None
        if letters:
            start -= len(letters[1])
        elif before in "+(":
            start -= 1
            if before == "(" and ")" not in m[0]:
                start += 1
            before = text[start - 1] if start else " "
        if not letters and (before.isalnum() or before in "._-+＠@"):
            continue
        if before == "/" and not (start > 1 and (text[start - 2].isalnum())):
            continue
        s = text[start:end]
        bw, bp, ap, aw = _around(text, start, end)
        shape = re.sub(r"\d", "0", s)
        digits = re.sub(r"\D", "", s)
        if len(digits) < 7 and not (letters and s[-1].isalpha()):
            continue
        two = " ".join(re.findall(r"[^\W\d_]+", text[max(0, start - 30) : start].lower())[-2:])
        features = [_h("n", shape), _h("nl", str(len(digits))), _h("np", s[:3]), _h("np2", s[:2]), _h("na", str(s[0].isalpha()) + str(s[-1].isalpha())), _h("nb", bw), _h("nb2", two), _h("nbp", bp[-1:]), _h("nap", ap[:1]), _h("naw", aw), _h("nbias")]
        features += [_h("ns", re.sub(r"0+", lambda z: str(len(z[0])), shape))]
        near = bw.rstrip(".")
        weak = 0 if near in CUE_NONE else 3 if near in CUE_ID else 2 if bw in CUE_PHONE or s[0] == "+" else None
        if re.fullmatch(r"\d{4}[-./]\d\d[-./]\d\d.*|\d{1,3}(\.\d{1,3}){3}", s):  # a date, a network address
            weak = 0
        elif re.fullmatch(r"\d\d(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])(?: ?- ?)?\d{7}", s):  # a resident registration number begins with a date
            weak = 3
        yield Candidate(start, end, "number", features, (digits,), weak)


def mail_candidates(text: str, signs: list[tuple[int, int]]) -> Iterator[Candidate]:
    for at, n in signs:
        plain = n == 1
        local = LOCAL.search(text[max(0, at - 80) : at])
        if not local or (plain and local[1]):
            continue
        domain = DOMAIN.match(text, at + n)
        if not domain or (plain and domain[0][0] == " "):
            continue
        start, end = at - len(local[0]), domain.end()
        spelled = bool(re.search(r"[\[(]| dot ", text[at:end], re.I))
        if n == 2 and not spelled and " " in domain[0].strip():
            continue
        bw, bp, ap, aw = _around(text, start, end)
        # "at example.com" without any sign of spelling out is prose more often than an address
        yield Candidate(start, end, "email", [_h("e", str(plain), str(spelled)), _h("ebias"), _h("ebp", bp[-1:])], (_fold(local[0]),), 1 if plain or spelled else 0)


def address_matches(text: str, at: list[int]) -> Iterator[re.Match]:
    """Addresses are sought around words that make a street, which stand at ``at``."""
    if not at:
        return
    at.sort()
    begin, end = max(0, at[0] - 70), at[0] + 100
    spans = []
    for i in at[1:]:
        if i - 70 <= end:
            end = i + 100
        else:
            spans.append((begin, end))
            begin, end = i - 70, i + 100
    for b, e in [*spans, (begin, end)]:
        while b > 0 and text[b - 1].isalnum():
            b -= 1
        while e < len(text) and text[e].isalnum():
            e += 1
        yield from ADDRESS.finditer(text, b, e)


def part_candidates(text: str, found: list[Candidate], model: Model | None) -> Iterator[Candidate]:
    """Words that stand alone elsewhere in the text, of names that their context could bear out without messages."""
    names = [c for c in found if c.group == "name" and (model is None or c.score >= model.reach)]
    words = {w for c in names for w in c.pair[:2] if len(w) > 2}
    if not words:
        return
    spans = sorted((c.start, c.end) for c in found)
    places = set()
    for w in words:
        i = text.find(w)
        while i >= 0:
            places.add((i, w))
            i = text.find(w, i + 1)
    k = 0
    for i, w in sorted(places):
        while k < len(spans) and spans[k][1] <= i:
            k += 1
        end = i + len(w)
        if any(a < end and i < b for a, b in spans[k : k + 2]) or (i and (text[i - 1].isalnum() or text[i - 1] in "@＠._-/")):
            continue
        if text[end : end + 1] == "s" and not text[end + 1 : end + 2].isalnum():
            end += 1
        if text[end : end + 1].isalnum() or text[end : end + 1] in ("-", "@", "＠", "_"):
            continue
        bw, bp, ap, aw = _around(text, i, end)
        folded = _stem(_fold(w))
        features = [*token_features("f", w), *token_features("g", w), _h("pbw", bw), _h("pbp", bp[-2:]), _h("pap", ap[:2]), _h("paw", aw), _h("pbias")]
        yield Candidate(i, end, "part", features, (folded,), 5 if bw.rstrip(".") in TITLE else None)


def candidates(text: str, model: Model | None = None) -> list[Candidate]:
    """All candidate segments of a text in order of place."""
    found: list[Candidate] = []
    korean = bool(_HANGUL.search(text))
    marks = [(end - back, n) for end, (back, n) in _MARKS.iter(text)]
    found += mail_candidates(text, [x for x in marks if x[1]])
    streets = [at for at, n in marks if not n]
    if korean:
        streets += [m.start() for m in KO_STREET.finditer(text)]
    for m in address_matches(text, streets):
        bw, bp, ap, aw = _around(text, m.start(), m.end())
        found.append(Candidate(m.start(), m.end(), "address", [_h("a", re.sub(r"[^\W\d_]+", "w", re.sub(r"\d+", "0", m[0]))), _h("abias"), _h("abw", bw), _h("abp", bp[-1:])], (_fold(m[0]),), 4))
    found += number_candidates(text)
    found += name_candidates(text, model)
    if korean:
        found += ko_candidates(text)
    found.sort(key=lambda c: (c.start, -c.end))
    # a number or name inside a mail address is no candidate
    taken, out = -1, []
    for c in found:
        if c.group == "email":
            taken = max(taken, c.end)
        elif c.start < taken:
            continue
        out.append(c)
    parts = list(part_candidates(text, out, model))
    return sorted(out + parts, key=lambda c: (c.start, -c.end)) if parts else out


class Model:
    """Hashed weights for each label, edge potentials, and what is remembered of tokens."""

    def __init__(self):
        self.w = np.zeros((K, 1 << HASH_BITS), np.float32)
        self.chain = np.zeros((K, K), np.float32)
        self.skip = np.zeros((K, K), np.float32)
        self.floor = self.reach = -1e9
        self.memo: dict[tuple[str, str], float] = {}

    def __getstate__(self):
        at = np.flatnonzero(np.abs(self.w).sum(axis=0))
        return {"at": at, "w": self.w[:, at], "chain": self.chain, "skip": self.skip, "floor": self.floor, "reach": self.reach}

    def __setstate__(self, s):
        self.__init__()
        self.w[:, s["at"]] = s["w"]
        self.chain, self.skip, self.floor, self.reach = s["chain"], s["skip"], s["floor"], s["reach"]

    def token_score(self, role: str, w: str) -> float:
        known = self.memo.get((role, w))
        if known is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            known = self.memo[(role, w)] = float(self.w[5].take(token_features(role, w)).sum())
        return known

    def unary(self, nodes: list[Candidate]) -> np.ndarray:
        """Local potentials of all nodes: one look-up of all features under the labels each may have, and sums."""
        pairs = [(i, k, c.features) for i, c in enumerate(nodes) for k in GROUPS[c.group]]
        node, label = (np.array(x, np.int64) for x in zip(*[(i, k) for i, k, _ in pairs]))
        sizes = np.array([len(f) for _, _, f in pairs])
        flat = np.fromiter((x for _, _, f in pairs for x in f), np.int64, int(sizes.sum()))
        out = np.full((len(nodes), K), -1e4, np.float32)
        out[:, 0] = 0.0
        out[node, label] = np.add.reduceat(self.w.reshape(-1)[flat + np.repeat(label << HASH_BITS, sizes)], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return out


def _weak_names(cands: list[Candidate], text: str) -> None:
    """Cue labels of Latin names: letters in a mail address within reach make a name; pairs of words that never do are none."""
    mails = [c for c in cands if c.group == "email"]
    for c in cands:
        if c.group != "name":
            continue
        given, family, bw, aw = c.pair
        family, given = c.tokens
        c.weak = 5 if bw.rstrip(".") in TITLE else 0
        for e in mails:
            if abs(e.start - c.end) < 140 or abs(c.start - e.end) < 140:
                local = e.tokens[0]
                if len(family) > 3 and family in local and given in local:
                    c.weak = 5


def _learn(w: np.ndarray, train: list[Candidate], rounds: int, rate: float, rng: np.random.Generator, batch: int = 8) -> None:
    """Logistic regression of each label against O, in small batches."""
    flat_w, size = w.reshape(-1), w.shape[1]
    examples = [(np.array(c.features, np.int64) + k * size, float(c.weak == k)) for c in train for k in GROUPS[c.group]]
    for r in range(rounds):
        step = rate / (1 + r)
        order = rng.permutation(len(examples)).tolist()
        for at in range(0, len(order), batch):
            some = [examples[i] for i in order[at : at + batch]]
            sizes = np.array([len(f) for f, _ in some])
            f = np.concatenate([f for f, _ in some])
            score = np.add.reduceat(flat_w[f], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            wrong = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - np.array([y for _, y in some])
            np.subtract.at(flat_w, f, np.repeat(step * (wrong + 0.0005 * score / sizes), sizes).astype(np.float32))


def edges(docs: list[list[Candidate]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``from, to, kind, scale`` of all edges of a batch's joint graph: kind 0 along the chain, 1 for a skip edge."""
    src, dst, kind, scale, at = [], [], [], [], 0
    for d in docs:
        for i in range(len(d) - 1):
            if 0 <= d[i + 1].start - d[i].end < NEAR:
                src.append(at + i)
                dst.append(at + i + 1)
                kind.append(0)
                scale.append(1.0)
        last: dict[str, int] = {}
        links = set()
        for i, c in enumerate(d):
            for t in c.tokens:
                if len(t) > 2:
                    if t in last:
                        links.add((last[t], i))
                    last[t] = i
        degree = defaultdict(int)
        for a, b in links:
            degree[a] += 1
            degree[b] += 1
        for a, b in sorted(links):
            src.append(at + a)
            dst.append(at + b)
            kind.append(1)
            scale.append(1.0 / max(degree[a], degree[b]))
        at += len(d)
    return np.array(src, np.int64), np.array(dst, np.int64), np.array(kind, np.int64), np.array(scale, np.float32)


def _fit_edges(model: Model, docs: list[list[Candidate]], steps: int = 200, rate: float = 4.0) -> None:
    """Edge potentials by pseudo-likelihood: each node's label given its neighbours', the local potentials held.

    Before anything is seen, equal tokens are expected to have equal labels (``AGREE``); the fit moves from there.
    """
    nodes = [c for d in docs for c in d]
    s, t, kind, scale = edges(docs)
    prior = np.stack([np.zeros((K, K)), np.diag([0.0] + [AGREE] * (K - 1))]).astype(np.float32)
    model.chain, model.skip = prior
    if not len(s):
        return
    unary = model.unary(nodes)
    y = unary.argmax(axis=1)
    known = np.array([c.weak is not None for c in nodes])
    y[known] = [c.weak for c in nodes if c.weak is not None]
    truth = np.eye(K, dtype=np.float32)[y]
    tables = prior.copy()
    for _ in range(steps):
        logits = unary.copy()
        np.add.at(logits, s, tables[kind, :, y[t]] * scale[:, None])
        np.add.at(logits, t, tables[kind, y[s], :] * scale[:, None])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong = (p / p.sum(axis=1, keepdims=True) - truth) * known[:, None]
        slope = np.zeros_like(tables)
        np.add.at(slope, (kind, slice(None), y[t]), wrong[s] * scale[:, None])
        np.add.at(slope, (kind, y[s]), wrong[t] * scale[:, None])
        slope[1] += slope[1].T.copy()
        tables -= rate * (slope / max(known.sum(), 1) + 0.0005 * (tables - prior))
        tables = np.clip(tables, np.array([-EDGE, -SKIP])[:, None, None], np.array([EDGE, SKIP])[:, None, None]).astype(np.float32)
    model.chain, model.skip = tables


def fit(texts: list[str], rounds: int = 12, rate: float = 0.5) -> Model:
    """Local weights by logistic regression on cue labels; edge potentials by pseudo-likelihood on documents that a second set of weights hasn't seen."""
    model = Model()
    docs = [candidates(t) for t in texts]
    for cands, t in zip(docs, texts):
        _weak_names(cands, t)
        for a, b in zip(cands, cands[1:]):
            # a number on its own after a name or an address is taken for a phone's
            if b.group == "number" and b.weak is None and a.group in ("address", "name", "name_ko") and t[a.end : b.start] in (", ", "\n"):
                b.weak = 2
    family = {c.tokens[0] for d in docs for c in d if c.group == "name" and c.weak == 5}
    given = {c.tokens[1] for d in docs for c in d if c.group == "name" and c.weak == 5}
    for d in docs:
        for c in d:
            if c.group == "name" and c.weak == 0:
                known = (c.tokens[0] in family) + (c.tokens[1] in given)
                # both parts known: a name; one part known: not used
                c.weak = 5 if known == 2 else None if known == 1 else 0
        # a word standing alone is what the names of its document say, if they agree
        said = defaultdict(set)
        for c in d:
            if c.group == "name":
                for t in c.tokens:
                    said[t].add(c.weak)
        for c in d:
            if c.group == "part" and c.weak is None and len(said[c.tokens[0]]) == 1:
                c.weak = next(iter(said[c.tokens[0]]))
    rng = np.random.default_rng(7)

    def known_of(some: list[list[Candidate]]) -> list[Candidate]:
        train = [c for d in some for c in d if c.weak is not None]
        none = [i for i, c in enumerate(train) if c.group in ("name", "part") and c.weak == 0]
        drop = set(rng.permutation(none)[30_000:].tolist()) if len(none) > 30_000 else set()
        return [c for i, c in enumerate(train) if i not in drop]

    half = Model()
    _learn(half.w, known_of(docs[::2]), 4, rate, rng)
    _fit_edges(half, docs[1::2])
    model.chain, model.skip = half.chain, half.skip
    train = known_of(docs)
    _learn(model.w, train, rounds, rate, rng)
    # beside the two words stand the context's features: the best of each kind together, and all that messages can add
    contexts = np.array([model.w[5, c.features[12:]] for c in train if c.group == "name"]).reshape(-1, 7)
    gain = [float((t[5] - t[0]).max()) for t in (model.chain, model.chain.T, model.skip)]
    model.reach = -float(contexts.max(axis=0).clip(0).sum()) if len(contexts) else 0.0
    model.floor = model.reach - sum(max(g, 0.0) for g in gain)
    return model


def infer(model: Model, docs: list[list[Candidate]]) -> list[np.ndarray]:
    """Marginals of each document's candidates by loopy message passing over one joint graph."""
    nodes = [c for d in docs for c in d]
    if not nodes:
        return [np.zeros((0, K)) for _ in docs]
    unary = model.unary(nodes)
    s, t, kind, scale = edges(docs)
    belief = unary
    if len(s):
        pot = np.stack([model.chain, model.skip])[kind] * scale[:, None, None]
        both = np.concatenate([pot, pot.transpose(0, 2, 1)])  # messages each way
        a, b = np.concatenate([s, t]), np.concatenate([t, s])
        back = np.concatenate([np.arange(len(s)) + len(s), np.arange(len(s))])
        msg = np.zeros((len(a), K), np.float32)
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, b, msg)
            out = (belief[a] - msg[back])[:, :, None] + both
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.mean(axis=1, keepdims=True)
            msg = 0.5 * msg + 0.5 * np.clip(new, -SKIP, SKIP)
        belief = unary.copy()
        np.add.at(belief, b, msg)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    ends = np.cumsum([len(d) for d in docs])
    return np.split(p, ends[:-1])


def decode(cands: list[Candidate], p: np.ndarray) -> list[tuple[int, int, str, float]]:
    """Findings without overlaps: the likelier first, then the longer, then the earlier."""
    best = p.argmax(axis=1) if len(p) else []
    ranked = sorted((-(p[i, k]), -(c.end - c.start), c.start, c.end, "name_part" if c.group == "part" else LABELS[k]) for i, (c, k) in enumerate(zip(cands, best)) if k)
    out: list[tuple[int, int, str, float]] = []
    for q, _, s, e, kind in ranked:
        if all(e <= a or s >= b for a, b, _, _ in out):
            out.append((s, e, kind, -float(q)))
    return sorted(out)


def findings(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float]]]:
    docs = [candidates(t, model) if t else [] for t in texts]
    return [decode(c, p) for c, p in zip(docs, infer(model, docs))]


def masked(text: str, found: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for s, e, kind, _ in found:
        out += [text[at:s], "[NAME]" if kind == "name_part" else f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> Model:
    """Fit on the ``most`` documents whose id has the least hash."""
    held = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    return fit([r["t"] for r in least_hashed(held, "k", most, documents.count())])


def redact(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, masked, found array<struct<kind, found, start, confidence>>`` for each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            found = findings([t or "" for t in texts], own)
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "masked": [None if t is None else masked(t, f) for t, f in zip(texts, found)],
                    "found": [[{"kind": k, "found": t[s:e], "start": s, "confidence": q} for s, e, k, q in f] for t, f in zip(texts, found)],
                }
            )

    kind = dict(documents.select(doc_id).dtypes)[doc_id]
    out = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"id {kind}, masked string, found array<struct<kind string, found string, start int, confidence double>>")
    return out.withColumnRenamed("id", doc_id)


def found_rows(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, kind, found``, distinct in each document: what ``redact`` replaces, without the texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts = batch["t"].tolist()
            rows = {(i, k, t[s:e]) for i, t, f in zip(batch["id"].tolist(), texts, findings(texts, own)) for s, e, k, _ in f if k != "name_part"}
            yield pd.DataFrame(sorted(rows), columns=["id", "kind", "found"])

    kind = dict(documents.select(doc_id).dtypes)[doc_id]
    held = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return held.mapInPandas(run, f"id {kind}, kind string, found string").withColumnRenamed("id", doc_id)
