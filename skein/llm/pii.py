"""Personal data by a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import rows_by_bytes, tidy, with_texts
from skein.llm.secrets import span_digest

BASE = ("email", "ip", "card", "phone")
#: Types of segments; those after the base types are found by the model alone.
KINDS = (*BASE, "masked_email", "local_phone", "ssn", "iban", "birth_date", "person", "address")
KIND = {k: i for i, k in enumerate(KINDS)}
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Entities that the model finds are at most so many tokens wide: groups of digits, pieces around an at sign, words.
GROUPS, PIECES, NAME_WORDS, BEFORE_STREET, AFTER_STREET = 6, 12, 4, 6, 6
_RUN = re.compile(r"(?<![\w@#+])\(?[0-9]++(?:[ ().\-/]{1,2}[0-9]++)+", re.ASCII)
_GROUP = re.compile(r"[0-9]++")
_NINE = re.compile(r"(?<![\w.])[0-9]{9}(?![\w.])")
#: Words of dates, streets and names in four languages.
_MONTHS = "january february march april may june july august september october november december janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz juni juli oktober dezember enero febrero marzo mayo junio julio agosto septiembre octubre noviembre diciembre jan feb mar apr jun jul aug sep sept oct nov dec"
_STREETS = "street st road rd avenue ave lane ln drive boulevard blvd court square terrace way rue chemin quai calle avenida plaza paseo weg allee gasse platz"
_NAME_CUES = r"my name is|name is|name:|i am|i'm|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|herr|frau|señor|señora|monsieur|madame|mme|signed|signed by|sincerely,?|regards,?|je m'appelle|ich heiße|me llamo|patient:?|customer:?|tenant:?|employee:?|contact:?|dear"
_MONTH = "(?:" + "|".join(sorted(_MONTHS.split(), key=len, reverse=True)) + r")\b\.?"
_DAY = r"[0-9]{1,2}(?:st|nd|rd|th|er|\.)?"
_WRITTEN = re.compile(rf"(?<!\w){_DAY} (?:of |de )?{_MONTH},?(?: de)? [0-9]{{4}}(?!\w)|(?<!\w){_MONTH} {_DAY},? [0-9]{{4}}(?!\w)", re.IGNORECASE)
_STREET = re.compile(rf"(?<!\w)(?:{'|'.join(_STREETS.split())})(?!\w)|\w++(?<=straße|trasse)(?!\w)|\w++(?<=str)\.", re.IGNORECASE)
_UPPER = r"[^\W\d_a-zß-öø-ÿ]"
_CAPITAL = rf"{_UPPER}(?:\.|[^\W\d_]*+(?:['’-][^\W\d_]++)*+)"
_NAME = re.compile(rf"{_CAPITAL}(?: (?:(?:van|von|de|der|del|la|di) ){{0,2}}{_CAPITAL}){{0,{NAME_WORDS}}}")
_CUE = re.compile(rf"(?<!\w)(?i:{_NAME_CUES})[ \n]+(?={_CAPITAL})")
_BORN = re.compile(r"[,(]? ?\(?(?:born|née?|geboren|geb\.|nacid[oa])\b", re.IGNORECASE)
_AT = re.compile(r" ?[\[({<] ?at ?[\])}>] ?| at ", re.IGNORECASE)
_DOT = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot |\.", re.IGNORECASE)
_PIECE = re.compile(r"[A-Za-z0-9_%+-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])++")
_TOKEN = re.compile(r"[^\W_]++(?:['’-][^\W_]++)*+\.?")
_CUES = {
    "masked_email": ("mail", "contact", "write", "reach", "schreib", "écri", "correo"),
    "local_phone": ("phone", "call", "tel", "fax", "mobile", "ring", "anruf", "appel", "llam", "handy", "cell"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "birth_date": ("born", "birth", "dob", "geboren", "geburt", "geb.", "né le", "née le", "naissance", "nacid", "nacimiento"),
    "person": ("name", "mr", "ms", "dr", "herr", "frau", "señor", "monsieur", "madame", "mme", "signed", "sincerely", "regards", "appelle", "heiße", "llamo", "patient", "customer", "contact", "dear", "i am", "i'm", "tenant", "employee"),
    "address": ("live", "address", "home", "resid", "at ", "adresse", "wohn", "habit", "vive", "domicil", "dirección", "house", "flat", "ship", "deliver", ","),
}
#: What a text must hold before it is searched: words, in lower case, and byte patterns.
_WORDS_OF = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_encoded = lambda words: frozenset(w.encode() for w in re.findall(r"[^\W\d_]+", words.lower()))
_CUE_WORDS, _STREET_WORDS, _MONTH_WORDS = _encoded(_NAME_CUES.replace(" is", "").replace("signed by", "signed").replace("i am|i'm", "am|i")) - {b"by", b"ich", b"je", b"me", b"i"} | {b"am"}, _encoded(_STREETS), _encoded(_MONTHS)
_BORN_WORDS = _encoded("born née né geboren geb nacido nacida")
_DIGIT, _BRACKETED, _COMPOUND = re.compile(rb"[0-9]"), re.compile(rb"[\[({<] ?[Aa][Tt] ?[\])}>]"), re.compile(rb"(?i)stra(?:\xc3\x9f|ss)e|str\.")


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_PART.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    """Dotted digit runs in fours, without retrying shorter readings."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, at + size
                at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


Segment = tuple[int, int, int]


def base_segments(text: str) -> list[Segment]:
    """Segments of the base types, by their definitions."""
    found = [(a, b, 0) for a, b in _emails(text)] + [(a, b, 1) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), 3))
    return found


def _numbers(text: str):
    """Runs of up to GROUPS groups of digits, whatever groups stand before and after."""
    for m in _NINE.finditer(text):
        yield *m.span(), KIND["ssn"]
    for m in _RUN.finditer(text):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i in range(len(groups)):
            n = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                n += groups[j][1] - groups[j][0]
                if n > 11:
                    break
                if j == i:
                    continue
                start, end, size = groups[i][0], groups[j][1], [b - a for a, b in groups[i : j + 1]]
                if start and text[start - 1] == "(" and ")" in text[start:end]:
                    start -= 1
                if n >= 7 and max(size) <= 7:
                    yield start, end, KIND["local_phone"]
                if n == 9 and len(size) == 3:
                    yield start, end, KIND["ssn"]
                if len(size) == 3 and (size[0] == 4 and max(size[1:]) <= 2 or max(size[:2]) <= 2 and size[2] in (2, 4)):
                    yield start, end, KIND["birth_date"]


def _masked(text: str):
    """Around an at sign in words: up to PIECES pieces joined by dots to its left and right, and all that there are."""
    for m in _AT.finditer(text):
        starts, at = [], m.start()
        while True:
            k = at
            while k and (text[k - 1].isalnum() and text[k - 1].isascii() or text[k - 1] in "_%+-"):
                k -= 1
            if k == at:
                break
            starts.append(k)
            before = next((d for n in (8, 7, 6, 5, 1) if k >= n and (d := _DOT.fullmatch(text, k - n, k))), None)
            if before is None:
                break
            at = before.start()
        ends, at = [], m.end()
        while p := _PIECE.match(text, at):
            ends.append(p.end())
            d = _DOT.match(text, p.end())
            if not d:
                break
            at = d.end()
        if starts and len(ends) > 1:
            for a in dict.fromkeys([*starts[:PIECES], starts[-1]]):
                for b in dict.fromkeys([*ends[1 : PIECES + 1], ends[-1]]):
                    yield a, b, KIND["masked_email"]


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        n = 0
        for g in re.finditer("[A-Z0-9]+", m[0][:68]):
            n += g.end() - g.start()
            if n > 34:
                break
            if n >= 15 and not text[m.start() + g.end() : m.start() + g.end() + 1].isalnum():
                yield m.start(), m.start() + g.end(), KIND["iban"]


def _streets(text: str):
    """Around a word for a street: all spans of tokens that hold a house number."""
    for m in _STREET.finditer(text):
        low = max(0, m.start() - 90)
        tokens = [(t.start(), t.end()) for t in _TOKEN.finditer(text, low, min(len(text), m.end() + 90))]
        at = next((i for i, (a, b) in enumerate(tokens) if a <= m.start() < b), None)
        if at is None:
            continue
        near = lambda i: re.fullmatch(r",? ?\n?", text[tokens[i][1] : tokens[i + 1][0]]) is not None
        first = last = at
        while first > max(0, at - BEFORE_STREET) and near(first - 1):
            first -= 1
        while last < min(len(tokens) - 1, at + AFTER_STREET) and near(last):
            last += 1
        number = [text[a].isdigit() for a, _ in tokens]
        if not any(number[first : last + 1]):
            continue
        able = [n or text[a].isupper() for n, (a, _) in zip(number, tokens, strict=True)]
        inner = [x or i == at or text[a:b].lower() in ("de", "la", "du", "des", "del", "of", "the", "am", "an", "der") for i, (x, (a, b)) in enumerate(zip(able, tokens, strict=True))]
        for i in range(first, at + 1):
            for j in range(at, last + 1):
                if any(number[i : j + 1]) and all(inner[i : j + 1]) and (able[i] or i == at) and (able[j] or j == at):
                    yield tokens[i][0], tokens[j][1] - (text[tokens[j][1] - 1] == "." and j != at), KIND["address"]


def _people(text: str, streets: list[Segment], cued: bool = True):
    """Capitalised words after a word that announces a name, or right before an address or a birth."""
    runs = [n for m in _CUE.finditer(text) if (n := _NAME.match(text, m.end()))] if cued else []
    ahead = {a for a, _, _ in streets} | {m.start() for m in _BORN.finditer(text)}
    for at in sorted(ahead):
        low = max(0, at - 60)
        for n in _NAME.finditer(text, low, at):
            if re.fullmatch(r"[,:]? ?\n?", text[n.end() : at]):
                runs.append(n)
    for n in runs:
        words = [(w.start(), w.end()) for w in _TOKEN.finditer(text, n.start(), n.end())]
        for i in range(len(words)):
            for j in range(i, min(len(words), i + NAME_WORDS + 1)):
                if text[words[i][0]].isupper() and text[words[j][0]].isupper():
                    yield words[i][0], words[j][1], KIND["person"]


def candidates(text: str, raw: bytes | None = None) -> list[Segment]:
    """(start, end, type) of every segment that may be an entity. Those of the base types are exact. The others are all spans
    of tokens to a bounded width around what may make them one: digits, an at sign, a word for a street or before a name.

    ``raw``: the text in UTF-8. Patterns are only searched where it holds what they need.
    """
    raw = text.encode() if raw is None else raw
    words = frozenset(raw.lower().translate(_WORDS_OF).split())
    digits, found = _DIGIT.search(raw) is not None, []
    if digits or b"@" in raw:
        found += base_segments(text)
    if b"dot" in words and b"at" in words or _BRACKETED.search(raw):
        found += _masked(text)
    streets: list[Segment] = []
    if digits:
        found += _numbers(text)
        found += _ibans(text)
        if not words.isdisjoint(_MONTH_WORDS):
            found += [(*m.span(), KIND["birth_date"]) for m in _WRITTEN.finditer(text)]
        if not words.isdisjoint(_STREET_WORDS) or _COMPOUND.search(raw):
            streets = list(_streets(text))
    cued = not words.isdisjoint(_CUE_WORDS)
    if cued or streets or not words.isdisjoint(_BORN_WORDS):
        found += _people(text, streets, cued)
    return found + streets


#: Features of a whole segment for each type: there; checks hold; a telling word just before; alone among spaces or
#: punctuation; touching letters or digits; of repeated or rising digits, as in samples; separators of one kind; the usual
#: shape; what stands before or after could belong to it; its width in tokens.
FEATURES = 11


def _date_ok(span: str) -> bool:
    parts = _digits(re.sub(r"[^0-9]+", " ", span)) and [int(x) for x in re.findall("[0-9]+", span)]
    if len(parts) != 3:
        return len(parts) == 2 and 1 <= parts[0] <= 31 and 1900 <= parts[1] <= 2025
    y, a, b = (parts[0], parts[1], parts[2]) if parts[0] > 31 else (parts[2], parts[0], parts[1])
    return (1900 <= y <= 2025 or y < 100 and len(re.findall("[0-9]+", span)[-1]) == 2) and (1 <= a <= 12 and 1 <= b <= 31 or 1 <= b <= 12 and 1 <= a <= 31)


def _valid(kind: str, span: str, digits: str) -> bool:
    if kind == "card":
        return luhn(digits)
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "iban":
        return _iban_ok(span)
    if kind == "local_phone":
        return len(digits) >= 9 and not _date_ok(span) and (len(digits) != 10 or digits[0] == "0" or digits[0] not in "1" and digits[3] not in "01")
    if kind == "birth_date":
        return _date_ok(span)
    if kind == "masked_email":
        return re.search(r"[\[({<] ?(?:at|dot)|(?: at ).*(?: dot )", span, re.IGNORECASE) is not None
    if kind == "address":
        return re.search(r"(?<![0-9])[0-9]{1,5}[a-zA-Z]?(?![0-9])", span) is not None and sum(c.isupper() for c in span) > 0
    return True


def _usual(kind: str, span: str) -> bool:
    shape = re.sub("[0-9]", "9", span)
    if kind == "local_phone":
        return re.fullmatch(r"\(?999\)?[ .-]?999[ .-]9999|9{2,3}[ .-]999[ .-]99[ .-]?99", shape) is not None or re.fullmatch(r"0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8}", span) is not None
    if kind == "ssn":
        return shape == "999-99-9999"
    if kind == "iban":
        return re.fullmatch(r"[A-Z0-9]{4}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z0-9]+", span) is not None
    if kind == "birth_date":
        return re.search("[12][0-9]{3}", span) is not None
    if kind == "masked_email":
        return re.search(r"[A-Za-z]{2,6}$", span) is not None and not re.search(r"(?i)(?:^|\W)(?:the|a|is|was|or|and|me|look|meet|us)(?: at |$)| at (?:the|a|an|this|that|my|our) ", span)
    if kind == "person":
        return 1 < len(span.split()) < 5
    if kind == "address":
        return re.match(r"[0-9]{1,5}[a-zA-Z]?,? ", span) is not None or re.search(r"(?i)(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|calle .*|avenida .*|plaza .*|paseo .*),? [0-9]{1,4}", span) is not None
    return True


def _more(kind: str, text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether what stands before and what stands after could belong to the segment."""
    if kind in ("local_phone", "ssn", "birth_date"):
        return re.search(r"[0-9][ ().\-/]{1,2}$", text[max(0, start - 3) : start]) is not None, re.match(r"[ ().\-/]{1,2}[0-9]", text[end : end + 3]) is not None
    if kind == "masked_email":
        before = re.search(r"(?i)[a-z0-9](?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)$", text[max(0, start - 12) : start]) is not None
        d = _DOT.match(text, end)
        return before, d is not None and _PIECE.match(text, d.end()) is not None
    if kind == "iban":
        return False, re.match(r" ?[A-Z0-9]*[0-9]", text[end : end + 6]) is not None
    if kind in ("person", "address"):
        before = text[max(0, start - 24) : start]
        return re.search(r"[^\W\d_a-zß-öø-ÿ](?:\.|[^\W\d_]*),? $" if kind == "person" else r"(?:[^\W_a-zß-öø-ÿ][^\W_]*|(?<!\w)[0-9]+[a-z]?),? $", before) is not None, re.match(r" [^\W\d_a-zß-öø-ÿ]" if kind == "person" else r",? (?:[^\W\d_a-zß-öø-ÿ]|[0-9])", text[end : end + 3]) is not None
    return False, False


def features(text: str, start: int, end: int, kind: int) -> np.ndarray:
    out, span, name = np.zeros((len(KINDS), FEATURES)), text[start:end], KINDS[kind]
    if kind < len(BASE):  # certain by definition
        out[kind, 0] = 1
        return out.ravel()
    digits = _digits(span)
    before = text[max(0, start - 40) : start].lower()
    cues = _CUES[name]
    near = any(w in before for w in cues) if name != "address" else any(w in before[-24:] for w in cues)
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    same = bool(digits) and name in ("local_phone", "ssn") and (len(set(digits)) <= 2 or digits in "01234567890123456789")
    left, right = _more(name, text, start, end)
    usual = _usual(name, span) or name == "person" and " " not in span and re.search(r"(?<!\w)(?:mr|mrs|ms|dr|prof|herr|frau|madame|mme|monsieur|señora?)\.? $", before) is not None
    seps = set(re.sub("[A-Za-z0-9()]", "", span)) if name in ("local_phone", "ssn", "birth_date") else set()
    out[kind] = 1, _valid(name, span, digits), near, not re.search(r"[\w@#/]", sides), bool(re.search(r"\w", sides)), same, len(seps) <= 1, usual, left, right, len(_TOKEN.findall(span)) / 4
    return out.ravel()


class SemiMarkov:
    """Segments of a type have weighted features and a weight for the type of the entity before them; text between has none.

    Only candidate segments can be entities, so a text of m candidates has a lattice of m nodes; a segment follows any that
    ends before it starts, and the dynamic program keeps the best path (or the sum of all) for each last type.
    """

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps  # steps[before, type]; before = len(KINDS): none yet

    def decode(self, text: str, segments: list[Segment]) -> list[Segment]:
        """The best set of segments that don't overlap: boundaries and types together."""
        segments = sorted(set(segments), key=lambda s: (s[1], s[0], s[2]))
        if not segments:
            return []
        scores, ends = np.array([features(text, *s) @ self.weights for s in segments]), sorted({e for _, e, _ in segments})
        none = len(KINDS)
        best = np.full((len(ends) + 1, none + 1), -np.inf)  # after the first i ends, by the last entity's type
        best[0, none] = 0.0
        back: list[dict] = [{} for _ in range(len(ends) + 1)]
        at = 0
        for i, e in enumerate(ends, 1):
            best[i] = best[i - 1]
            while at < len(segments) and segments[at][1] == e:
                start, _, kind = segments[at]
                j = bisect.bisect_right(ends, start)
                through = best[j] + self.steps[:, kind] + scores[at]
                before = int(through.argmax())
                if through[before] > best[i, kind]:
                    best[i, kind], back[i][kind] = through[before], (at, j, before)
                at += 1
        out, i, kind = [], len(ends), int(best[-1].argmax())
        while kind != none:
            while kind not in back[i]:
                i -= 1
            s, i, kind = back[i][kind]
            out.append(segments[s])
        return out[::-1]

    def gradient(self, segments: list[Segment], feats: np.ndarray, truth: set[Segment]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of a labelled set of segments; ``segments`` stand in order of their ends, with their features."""
        none, n, scores = len(KINDS), len(segments), feats @ self.weights
        starts, ends, kinds = (np.array(x) for x in zip(*segments, strict=True))
        follows = ends[:, None] <= starts[None, :]
        step = self.steps[kinds[:, None], kinds[None, :]]
        ahead, behind = np.zeros(n), np.zeros(n)
        for i in range(n):
            ahead[i] = scores[i] + np.logaddexp.reduce([self.steps[none, kinds[i]], *(ahead[:i] + step[:i, i])[follows[:i, i]]])
        for i in reversed(range(n)):
            behind[i] = np.logaddexp.reduce([0.0, *(scores + step[i] + behind)[follows[i]]])
        z = np.logaddexp.reduce([0.0, *ahead])
        is_true = np.array([s in truth for s in segments], float)
        g, gs = (is_true - np.exp(ahead + behind - z)) @ feats, np.zeros_like(self.steps)
        np.subtract.at(gs, (none, kinds), np.exp(self.steps[none, kinds] + scores + behind - z))
        i, j = np.nonzero(follows)
        np.subtract.at(gs, (kinds[i], kinds[j]), np.exp(ahead[i] + step[i, j] + scores[j] + behind[j] - z))
        before = none
        for _, _, kind in sorted(truth):
            gs[before, kind] += 1
            before = kind
        return g, gs


def _examples(n: int, seed: int):
    """Labelled sentences in four languages: entities in telling and in neutral surroundings, beside numbers and words that
    don't belong to them, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    d1 = lambda k: str(rng.integers(2, 9)) + d(k - 1)
    word = lambda: "".join(rng.choice(list("aeioulnrstéä"), rng.integers(3, 8)))
    plain = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(3, 8)))
    cap = lambda: word().capitalize()
    num = lambda a, b: int(rng.integers(a, b))

    def card():
        body = d1(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        body = d(18)
        found = next(s for k in range(2, 99) if _iban_ok(s := f"DE{k:02d}{body}"))
        return found if rng.random() < 0.5 else " ".join(found[i : i + 4] for i in range(0, 22, 4))

    def phone():
        return pick(f"{d1(3)}-{d1(3)}-{d(4)}", f"({d1(3)}) {d1(3)}-{d(4)}", f"{d1(3)}.{d1(3)}.{d(4)}", f"{d1(3)} {d1(3)} {d(4)}", f"0{num(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{num(30, 99)} {d1(7)}")

    def date():
        y, m, k = num(1930, 2010), num(1, 13), num(1, 29)
        month = pick(*_MONTHS.split()[:12]).capitalize()
        return pick(f"{y}-{m:02d}-{k:02d}", f"{k:02d}/{m:02d}/{y}", f"{k}.{m}.{y}", f"{k} {month} {y}", f"{month} {k}, {y}", f"{k}. {pick('März', 'Januar', 'Juli')} {y}", f"{k} de {pick('enero', 'mayo', 'julio')} de {y}")

    def person(alone=False):
        return cap() if alone else pick(f"{cap()} {cap()}", f"{cap()} {cap()[0]}. {cap()}", f"{cap()} van {cap()}", f"{cap()} {cap()}", f"{cap()} {cap()}-{cap()}")

    def address():
        town = pick("", f", {cap()}", f", {cap()} {d1(5)}", f", {d1(5)} {cap()}")
        return pick(f"{num(1, 9999)} {cap()} {pick('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'St', 'Rd', 'Blvd')}", f"{num(1, 999)} {cap()} {cap()} {pick('Street', 'Road', 'Square')}", f"{num(1, 200)} rue {pick('de la ', 'du ', '')}{cap()}", f"{cap()}straße {num(1, 200)}", f"{cap()} {pick('Weg', 'Allee', 'Platz')} {num(1, 99)}", f"Calle {cap()} {num(1, 99)}") + town

    makers = [
        lambda: f"{plain()}.{d(2)}@{plain()}.com", lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)), card, lambda: f"+{d1(1)} ({d1(3)}) {d(3)}-{d(4)}",
        lambda: pick(f"{plain()} [at] {plain()} [dot] org", f"{plain()}.{plain()} (at) {plain()}.com", f"{plain()} at {plain()} dot {plain()} dot net", f"{plain()} [dot] {plain()} [at] {plain()} [dot] co [dot] uk", f"{plain()}{{at}}{plain()}.{plain()}.de"),
        phone, lambda: pick(f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", f"{rng.integers(100, 600)} {rng.integers(10, 99)} {rng.integers(1000, 9999)}"), iban, date, person, address,
    ]
    cues = {
        4: ("mail me", "write to", "contact", "e-mail:", "correo:", ""), 5: ("phone", "call", "tel.", "mobile:", "llame al", "Telefon", "fax"), 6: ("ssn", "social security number", "SSN:"),
        7: ("iban", "account", "IBAN:", ""), 8: ("born", "born on", "date of birth:", "DOB", "geboren am", "née le", "nacido el"), 9: ("my name is", "Mr.", "Mrs.", "Dr.", "name:", "Herr", "Frau", "Monsieur", "signed", "ich heiße", "me llamo", "Dear", "patient:", "I am"),
        10: ("lives at", "address:", "resides at", "home address", "wohnt in", "habite", "vive en", "ship to", "she moved to", ""),
    }
    decoys = [
        lambda: f"{rng.integers(0, 2)}{d(2)}-{d(3)}-{d(4)}", lambda: f"#{d1(3)}-{d1(3)}-{d(4)}x", lambda: f"{d1(3)}.{d(3)}.{d(4)}/a", lambda: "000-00-0000", lambda: "DE" + d(20), lambda: f"{d1(3)} {d(3)} {d(4)}", lambda: f"part {d(3)}-{d(2)}-{d(4)}",
        lambda: f"on {date()}", lambda: f"version {num(1, 9)}.{num(1, 20)}.{num(1, 99)}", lambda: f"{d1(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"look at the {plain()} dot {plain()}", lambda: f"meet us at {plain()}.{plain()}", lambda: f"{cap()} {cap()} {word()}",
        lambda: f"the street of {num(1, 99)} {word()}", lambda: f"dans la rue, {num(1900, 2020)} {word()}", lambda: f"in {num(1900, 2020)} the road to {cap()}", lambda: f"{cap()}. {cap()} {word()} {num(2, 90)} {word()}", lambda: f"{d1(4)}-{d1(4)}", lambda: f"{cap()} {cap()} st {word()} {num(1, 99)} {word()}", lambda: f"{cap()} {cap()}, {num(1, 99)} {word()} street", lambda: f"look at the dot {plain()}", lambda: f"dear {word()}", lambda: f"the road to {cap()} has {num(2, 90)}", lambda: f"regards, {word()}", lambda: f"{num(1, 99)} {word()} on the way", lambda: f"sections {num(1, 9)}.{num(1, 9)} - {num(10, 99)}.{num(1, 9)}.{num(100, 999)}",
    ]
    for _ in range(n):
        text, truth = word(), []
        for _ in range(rng.integers(1, 4)):
            text += f" {word()} "
            if rng.random() < 0.4:
                text += decoys[rng.integers(len(decoys))]() + pick(" ", ". ", ", ")
                continue
            kind = int(rng.integers(len(makers)))
            if kind == 9 and rng.random() < 0.3:  # a name, its address and birth in a row
                for k, lead, value in ((9, pick(f"{word()}. ", ""), person()), (10, ", ", address()), (8, ", born ", date())):
                    text += lead
                    truth.append((len(text), len(text) + len(value), k))
                    text += value
                text += pick(".", ",")
                continue
            cue = pick(*cues.get(kind, ("",)))
            value = person(cue in ("Mr.", "Mrs.", "Dr.", "Herr", "Frau", "Monsieur") and rng.random() < 0.4) if kind == 9 else makers[kind]()
            text += f"{cue} " if cue else ""
            truth.append((len(text), len(text) + len(value), kind))
            text += value
            if kind in (5, 6, 8) and rng.random() < 0.4:
                text += pick(f" {num(2, 90)} {word()}", f", {num(2, 9)} {word()}", f" ({num(1, 9)})", f" / {num(1, 99)}")
            elif kind == 9 and rng.random() < 0.4:
                text += pick(f". {cap()} {word()}", f" {word()}", f", {word()}")
        yield text + f" {word()}.", truth


@functools.cache
def trained(sentences: int = 1200, epochs: int = 5, seed: int = 5) -> SemiMarkov:
    """The model, fitted on generated sentences by gradient ascent. The same arguments give the same weights."""
    model, data = SemiMarkov(np.zeros(len(KINDS) * FEATURES), np.zeros((len(KINDS) + 1, len(KINDS)))), []
    model.weights.reshape(len(KINDS), FEATURES)[:, 0] = -1.0
    for text, truth in _examples(sentences, seed):
        segments = sorted(set(candidates(text)) | set(truth), key=lambda s: (s[1], s[0], s[2]))
        if segments:
            data.append((segments, np.array([features(text, *s) for s in segments]), set(truth)))
    for epoch in range(epochs):
        for segments, feats, truth in data:
            g, gs = model.gradient(segments, feats, truth)
            model.weights += 0.2 / (1 + epoch) * g
            model.steps += 0.05 / (1 + epoch) * gs
    return model


def scan(raw: bytes, model: SemiMarkov) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of a whole text, by start and then kind.

    Segments of the base types are certain and stay; what the model chooses beside them is added.
    """
    text = raw.decode()
    segments = candidates(text, raw)
    if not segments:
        return []
    base = {s for s in segments if s[2] < len(BASE)}
    added = set()
    if len(base) < len(segments):
        edges = sorted((a, b) for a, b, _ in base)
        starts, reach = [a for a, _ in edges], np.maximum.accumulate([b for _, b in edges]) if edges else []
        free = [s for s in segments if s[2] >= len(BASE) and (not (i := bisect.bisect_left(starts, s[1])) or reach[i - 1] <= s[0])]
        added = {s for s in model.decode(text, free + list(base)) if s[2] >= len(BASE)} if free else set()
    return [(KINDS[k], a, b) for a, b, k in sorted(base | added, key=lambda s: (s[0], s[2], s[1]))]


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every document: the base types by their definitions, others as the model chooses.

    Offsets are code points, the end exclusive. Null and empty texts have no span; repeated rows are scanned each; a null
    doc_id stays null; other columns are not read. Time grows with a text's length, and with candidates not worse than n log n.
    """
    model = trained()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", span)])

    def run(batches):
        for batch in rows_by_bytes(batches):
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py(), model)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, span)], schema=schema)

    return with_texts(docs, "doc_id").mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame) -> DataFrame:
    """The table with personal data in ``text`` replaced, ``n_chars`` (where it stands) counted anew; null texts stay null."""
    from pyspark.sql import functions as F

    model = trained()

    def run(batches):
        for batch in rows_by_bytes(batches, text="text"):
            i = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, found) if (found := scan(t.encode(), model)) else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return out


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return span_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
