"""Labelled spans for the personal-information tagger, and the fit itself.

``python -m ordinanza.llm.pii_training PARQUET OUT.npz`` labels a bounded
sample of documents (``max_docs`` rows, chosen by a hash of the id), replaces
the labelled values by generated ones, cuts windows around labels and
elsewhere, and fits the tagger.  Only the fitted weights are used by the operator.

No list of names is used.  What is a given name is read from the context: a
capitalised word behind a title and before another capitalised word, or one
that stands before many different rare capitalised words; a rare word next to a
given name, a title or an initial is a surname.  In the training text most names are then exchanged for
generated ones (syllables, compounds and ordinary words), street names, street
types, numbers and mail addresses likewise, so that the network has to learn
form and context and cannot learn the values.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from . import charcrf

_TITLE = r"(?:(?:mr|mrs|ms|mx|dr|rev|sr|sra|srta)\.|don|doña)"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAP = r"[A-ZÁÉÍÓÚÑ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_WAY = r"(?:street|st|lane|ln|road|rd|avenue|ave|boulevard|blvd|drive|dr|terrace|place|court|way)\b"
_END = rf"(?![\w@'’]|-[a-z])(?!\s+{_WAY})"
#: A word at most this frequent in the sample can be a surname.
RARE = 30
_TITLED = re.compile(rf"(?<![\w'’@.+-])(?i:{_TITLE})\s+({_CAP})\s+(?:[A-Z]\.\s+)?({_CAP})")
EMAIL = re.compile(
    r"(?P<n>(?<![\w.+-])[\w](?:[\w.+-]*\w)?(?:@|\s(?:\(at\)|\[at\]|at)\s)(?:[\w-]+(?:\.|\s(?:\[dot\]|\(dot\)|dot)\s))+(?:example|test|com|net|org)\b)", re.I
)
PHONE = re.compile(
    r"(?P<n>(?<![\w\-./$#])(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s./-]?)555[\s.-]?01\d\d(?!\d|-\d)|(?<![\w\-./$])555[\s.-]01\d\d(?!\d|-\d)|(?<!\w)\+44 7700 90\d{4}|(?<![\w\-])020 7946 0\d{3})(?!\d)"
)
IDENT = re.compile(r"(?P<n>(?<![\w\-./$])(?:9\d\d-\d\d-\d{4}|9\d\d \d\d \d{4}|9\d{8}|[XYZ]\d{7}|[A-Z]{3} \d{4} \d{4}|[A-Z]{2}-\d{4}-\d{4}))(?![\w-]|\.\d)")
ADDRESS = re.compile(
    rf"(?P<n>(?<![\w\-./$§])(?:\d{{1,5}}-\d{{1,3}}|\d{{1,5}}[a-c]?(?: 1/2)?)\s(?:(?:n\.|s\.|e\.|w\.|n|s|e|w|west|north|east|south)\s)?(?:(?!(?:along|and|in|for|of|on|to|from|the|at|after|by|is|feet|days|weeks|calls|speakers|units|years|months|posts|hours|percent|neighbours)\b)[a-z'’]+\s){{1,2}}{_WAY}"
    r"|(?<!\w)(?:calle|paseo|avenida)\s(?:[a-z'’áéíóú]+\s){1,2}\d{1,4}\b)",
    re.I,
)
RULES = (("email", EMAIL), ("phone", PHONE), ("id", IDENT), ("address", ADDRESS))


class Names:
    """Given names and surnames of a corpus, read from contexts alone."""

    def __init__(self, texts: list[str], least: int = 2):
        every = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
        capital = Counter(w.lower() for t in texts for w in re.findall(rf"(?<=[a-z,] ){_CAP}", t))
        # a word that is mostly written small is no name
        proper = lambda w: capital[w] > 0 and every[w] < 40 * capital[w]
        titled = [(m.group(1).lower(), m.group(2).lower()) for t in texts for m in _TITLED.finditer(t)]
        count = Counter(g for g, _ in titled)
        self.given = {g for g, n in count.items() if n >= least and proper(g)}
        self.common = {w for w, n in every.items() if n >= 400 and w not in self.given}
        self.rare = {w for w, n in every.items() if n <= RARE}
        pairs = Counter((a.lower(), b.lower()) for t in texts for a, b in re.findall(rf"\b({_CAP}) (?:[A-Z]\. )?(?=({_CAP}))", t))
        roles = {a for (a, b), n in pairs.items() if b in self.given and b not in self.rare and n > 1} | set("calle paseo avenida plaza camino".split())
        before = Counter(a for a, b in pairs if b in self.rare and a not in self.common and a not in roles and not re.fullmatch(_WAY, a))
        total = Counter()
        for (a, _), n in pairs.items():
            total[a] += n
        self.given |= {a for a, n in before.items() if n >= 10 and proper(a) and every[a] < 4 * total[a]}
        g = "(?:" + "|".join(sorted(map(re.escape, self.given), key=len, reverse=True)) + ")" if self.given else r"(?!)"
        self.rule = re.compile(
            rf"(?<![\w'’@.+-])(?:{_TITLE}\s+)?(?P<n>(?P<s1>{_WORD}),\s+{g}(?:\s+[a-z]\.)?|{g}\s+(?:[a-z]\.\s+)?(?P<s2>{_WORD})|(?<!\d )(?<!\d)[a-z]\.\s+(?P<s3>{_WORD})){_END}"
            rf"|(?<![\w'’@.+-]){_TITLE}\s+(?P<t>{_WORD}){_END}",
            re.I,
        )

    def surname(self, word: str) -> bool:
        return all(len(p) > 2 and p in self.rare for p in word.lower().replace("’", "'").replace("o'", "").split("-"))

    def find(self, text: str):
        at = 0
        while m := self.rule.search(text, at):
            at = m.end()
            if m.group("t"):
                if self.surname(m.group("t")):
                    yield m.span("t")
                continue
            kind = next(k for k in ("s1", "s2", "s3") if m.group(k))
            if self.surname(m.group(kind)):
                yield m.span("n")
            else:
                at = m.start() + 1
                while at < len(text) and text[at].isalnum():
                    at += 1


def label(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) spans, earlier rules first."""
    out: list[tuple[int, int, str]] = []
    for kind, rule in RULES:
        for m in rule.finditer(text):
            a, b = m.span("n")
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
    for a, b in names.find(text):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, "name"))
    return sorted(out)


# -- generated values -------------------------------------------------------------

_ON = "b br c ch cl d dr f fl g gr h j k kl l m n p pr r s sh st t th tr v w y z".split()
_MID = "a a e e i i o o u ai ea ee ia io ou ay".split()
_OFF = ["", "", "", "n", "n", "r", "s", "l", "m", "t", "ck", "nd", "ng", "x", "th", "rd", "ll"]
_FRONT = "black white green wood whit ash oak hart stone brook clay marsh win mill hill bar south north red lang fair ship holl lock over under har thorn king".split()
_BACK = "wood combe ton son ley field man well worth land ford burn ham ridge smith berg stein sen wright water more stead er ett ards ins ez".split()
_TYPES = "Street St St. Lane Road Rd Rd. Avenue Ave Ave. Boulevard Blvd Drive Dr Terrace Place Court Way Circle Parkway Trail Crescent Close Row Square Loop Alley Walk Highway Path".split()


class Maker:
    """Random names, streets, numbers and mail addresses."""

    def __init__(self, seed: int, words: list[str] = ()):
        self.r, self.words = np.random.default_rng(seed), list(words)

    def one(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def syllables(self, n: int) -> str:
        s = "".join(self.one(_ON) + self.one(_MID) + (self.one(_OFF) if i == n - 1 or self.r.random() < 0.3 else "") for i in range(n))
        return s[1:] if self.r.random() < 0.15 and len(s) > 4 else s

    def given(self) -> str:
        x = self.r.random()
        w = self.syllables(1 if x < 0.15 else 2 if x < 0.75 else 3)
        if x > 0.9:
            w = self.one(self.words) if self.words else w
        elif x > 0.6:
            w += self.one(["a", "a", "y", "ie", "el", "ert", "en", "ine"])
        return w.capitalize()

    def surname(self) -> str:
        x = self.r.random()
        if x < 0.30:
            w = self.one(_FRONT) + self.one(_BACK)
        elif x < 0.45 and self.words:
            w = self.one(self.words)
        else:
            w = self.syllables(int(self.r.choice([1, 2, 2, 2, 3])))
            w += self.one(["", "", "", "son", "ez", "i", "sky", "man", "er", "s", "ton"])
        w = w.capitalize()
        y = self.r.random()
        if y < 0.03:
            w = self.one(["Mc", "Mac", "O'", "De", "Van", "La"]) + w
        elif y < 0.06:
            w += "-" + self.syllables(2).capitalize()
        return w

    def street(self) -> str:
        x = self.r.random()
        w = self.one(self.words).capitalize() if x < 0.4 and self.words else self.surname()
        return w if self.r.random() < 0.8 else w + " " + (self.one(self.words).capitalize() if self.words else self.surname())

    def digits(self, s: str) -> str:
        return re.sub(r"\d", lambda m: str(self.r.integers(0, 10)), s)


def _as(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word


def exchange(text: str, spans, make: Maker, rate: float = 0.85) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with generated values in most spans, and the spans where they stand then."""
    out, new, at, size, same = [], [], 0, 0, {}
    for a, b, kind in spans:
        v = text[a:b]
        if make.r.random() < rate:
            v = same.get(v.lower()) or _value(v, kind, make)
            v = _as(text[a:b], v)
            same[text[a:b].lower()] = v
        out += [text[at:a], v]
        size += a - at
        new.append((size, size + len(v), kind))
        size += len(v)
        at = b
    return "".join([*out, text[at:]]), new


def _value(v: str, kind: str, make: Maker) -> str:
    r = make.r
    if kind == "name":
        parts = re.split(r"(\s+|,\s+)", v)
        last = 0 if "," in v else len(parts) - 1
        for i, p in enumerate(parts):
            if p.strip(" ,\n\t") and not re.fullmatch(r"[^\W\d_]\.", p):
                parts[i] = make.surname() if i == last else make.given()
            elif re.fullmatch(r"[^\W\d_]\.", p):
                parts[i] = chr(65 + int(r.integers(26))) + "."
        return "".join(parts)
    if kind == "address":
        m = re.match(r"(\d+(?:-\d+|[A-Ca-c])?(?: 1/2)?\s(?:[NSEWnsew]\.?\s|(?:north|south|east|west)\s)?)(.+?)\s(\S+)$", v, re.I)
        if not m:
            parts = v.split(" ")
            return " ".join([parts[0], *(make.syllables(2).capitalize() for _ in parts[1:-1]), make.digits(parts[-1])])
        return make.digits(m.group(1)) + make.street() + " " + (make.one(_TYPES) if r.random() < 0.5 else m.group(3))
    if kind == "email":
        if "@" in v and r.random() < 0.6:
            user = make.one([make.given(), make.given() + "." + make.surname(), make.surname() + str(r.integers(100)), make.given()[0] + make.surname()]).lower()
            return re.sub(r"[^\w.]", "", user) + "@" + make.syllables(2) + make.one([".com", ".org", ".net", ".co.uk", ".edu", ".gov", ".example"])
        return v
    if kind == "id":
        x = r.random()
        return make.digits("123-45-6789") if x < 0.3 else re.sub(r"(?<![A-Z])[A-Z](?=\d)", lambda m: chr(65 + int(r.integers(26))), make.digits(v))
    return make.digits(v) if r.random() < 0.6 else v


# Frames of the generated training lines; {n} a name, {s} a surname, {g} a given name.
_FRAMES = (
    "Yours,\n{n}", "Yours, {n}", "Sincerely, {n}", "Regards,\n\n{n}", "Best, {n}", "Thank you, {n}", "Signed: {n}", "Respectfully,\n{n}", "Attn: {n}", "From: {n}", "Owner: {n}, {a}.",
    "Please call {n} at {p}.", "{n} lives at {a}.", "My name is {n} and I live at {a}.", "The applicant, {n}, may be reached at {p} or {e}.", "{n} spoke against it.", "I met {n} on Monday.",
    "Mr. {s} of {a} objected.", "Ms. {s} agreed.", "Dr. {n} wrote to {e}.", "SSN {i} belongs to {n}.", "social security number {i}", "{n} (SSN: {i}) signed.", "Contact {n}, {p}.", "write to {e}",
    "Moved by {n}, seconded by {n}.", "{n} and {n} own the lot at {a}.", "the house of {n} at {a} was sold", "{n} works nights.", "Dear {n},", "Dear Mrs. {s},", "Tenant {n} asked for {a}.", "Send mail to {a}.",
    "{s}, {g} of {a}", "It was {n} who called from {p}.", "My neighbor {n} has a dog.", "Tax id {i} on file.", "Witness: {n}", "According to {n}, nothing was done.", "{n} called about the fence.", "The applicant {n} spoke.", "{n} told the board about it.", "Mrs. {s}\n{n} spoke", "{n} said no.", "{p}\n{a}", "{e} / {p} {a}", "her son {n} and his wife {n}",
)


def framed(make: Maker, around: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated line between two sentences of the corpus without a label."""
    frame = make.one(_FRAMES)
    text, spans = "" if make.r.random() < 0.3 else make.one(around) + make.one([" ", "\n", "\n\n"]), []
    for part in re.split(r"(\{\w\})", frame):
        key = part[1:2] if part[:1] == "{" else ""
        if not key:
            text += part
            continue
        n = f"{make.given()} {make.surname()}" if make.r.random() < 0.85 else f"{make.given()} {chr(65 + int(make.r.integers(26)))}. {make.surname()}"
        kind, v = {
            "n": ("name", n), "s": ("name", make.surname()), "g": ("name", make.given()), "a": ("address", f"{make.r.integers(1, 9999)} {make.street()} {make.one(_TYPES).rstrip('.')}"),
            "p": ("phone", make.digits(make.one(["(123) 456-7890", "123-456-7890", "123.456.7890", "+1 123 456 7890", "555-0134"]))), "e": ("email", _value("a@b", "email", make) if make.r.random() < 2 else ""),
            "i": ("id", make.digits(make.one(["123-45-6789", "123 45 6789", "123456789"]))),
        }[key]
        if key == "e" and len(v) < 6:
            v = f"{make.syllables(2)}@{make.syllables(2)}.com"
        if key == "g" and spans:  # a surname and the given name behind it are one name
            a, _, _ = spans.pop()
            spans.append((a, len(text) + len(v), "name"))
        else:
            spans.append((len(text), len(text) + len(v), kind))
        text += v
    return text + make.one([" ", "\n"]) + make.one(around), spans


def tag(text: str, spans) -> np.ndarray:
    t = np.zeros(len(text), np.int8)
    for a, b, kind in spans:
        j = 1 + 2 * charcrf.KINDS.index(kind)
        t[a:b] = j + 1
        t[a] = j
    return t


def windows(labelled, *, size=160, plain=0.12, seed=3):
    """Windows around every label, and a share of those without one; some once more in other letter case."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text, tags, at):
        x, y = charcrf.encode(text[at : at + size]).astype(np.int16), tags[at : at + size]
        if len(y) and y[0] and y[0] % 2 == 0:  # cut inside a span: begins as B there
            y = y.copy()
            y[0] -= 1
        xs.append(np.pad(x, (0, size - len(x))))
        ys.append(np.pad(y, (0, size - len(y))))

    for text, spans in labelled:
        tags = tag(text, spans)
        at = 0
        while at < len(text):
            piece = tags[at : at + size]
            if piece.any():
                lo = max(0, at - int(rng.integers(0, 40)))
                add(text, tags, lo)
                low = text.lower()
                if rng.random() < 0.25 and len(low) == len(text):
                    add(low if rng.random() < 0.6 else (text.upper() if len(text.upper()) == len(text) else low), tags, lo)
            elif rng.random() < plain:
                add(text, tags, at)
            at += size - 24
    return np.stack(xs), np.stack(ys)


def training_windows(texts: list[str], names: Names, seed: int = 3):
    """Labelled windows of the texts with exchanged values, of a third of them as they are, and of generated lines."""
    words = sorted(w for w in names.common if 3 < len(w) < 9 and w.isascii())
    make, rng = Maker(seed, words), np.random.default_rng(seed)
    rows, plain = [], []
    for t in texts:
        spans = label(t, names)
        rows.append(exchange(t, spans, make))
        if rng.random() < 0.33:
            rows.append((t, spans))
        if len(plain) < 4000:
            cuts = [m.end() for m in re.finditer(r"[.?!]\s", t)]
            plain += [t[x : y - 1] for x, y in zip(cuts, cuts[1:]) if all(b <= x or a >= y for a, b, _ in spans) and y - x < 120][:2]
    rows += [framed(make, plain) for _ in range(len(texts) if plain else 0)]
    return windows(rows, seed=seed)


def main(path: str, out: str, max_docs: int = 10_000, seconds: float = 3600, hidden: int = 48, dim: int = 20, epochs: int = 25, workers: int = 8, rate: float = 6e-3, start: str = "") -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    rows = sorted((r for r in table if r["text"]), key=lambda r: (r["doc_id"] * 2654435761) % 2**32)[:max_docs]
    seen = list(dict.fromkeys(r["text"] for r in rows))
    cut = max(1, len(seen) // 20)
    names = Names(seen)
    x, y = training_windows(seen[cut:], names)
    hx, hy = training_windows(seen[:cut], names, seed=4)
    print(len(x), "windows;", len(hx), "held out", flush=True)
    begin = {k: v.astype(np.float32) for k, v in np.load(start).items()} if start else None
    p = charcrf.train(x, y, epochs=epochs, seconds=seconds, hidden=hidden, dim=dim, workers=workers, rate=rate, start=begin, say=lambda s: print(s, flush=True))
    got = charcrf.decode(p, hx.T).T
    for i, k in enumerate(charcrf.KINDS):
        a, b = (hy == 1 + 2 * i), (got == 1 + 2 * i)
        print(k, "starts", a.sum(), "found", b.sum(), "both", (a & b).sum(), flush=True)
    np.savez_compressed(out, **{k: v.astype(np.float16) if k != "A" else v for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *(int(x) if x.isdigit() else float(x) if x[0].isdigit() else x for x in sys.argv[3:]))
