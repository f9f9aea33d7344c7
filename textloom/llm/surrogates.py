"""PII: every detected entity gets a keyed surrogate of its own kind.

Kinds: e-mail and its domain, phone, IPv4 and IPv6, card or account number, social
security number, IBAN, secret, and names. A person is found by an honorific and up to
three names after it; then every further mention of these names in the document, with
or without honorific, is one too. Of a name with hyphens or an apostrophe each part is a
name (but for parts of one or two letters, as in O'Brien), so separators stay.

A surrogate keeps what its type is made of: lengths, separators, case, script, digits
of the same numeral system, the check digit's validity, a name's gender; e-mail domains
end in example.com, .org or .net. A name's gender is that of most honorifics before it
over the corpus where it is a given name; without any, that of its ending (Cyrillic and
Greek), else neutral.

It is drawn from a keyed hash of the entity's canonical form alone, so that all mentions
of one entity, in whatever format, place and document, get the same (coreference: "Mr.
Ray", "Dr. Tom Ray" and "Ray" agree). Collisions are checked over the whole corpus: if
two entities of a kind draw one surrogate, or one draws a real entity, all but the first
(by draws, then form) draw again, until none is left; from GROW draws on surrogates get
longer, so there is an end. What drew again, or whose gender its ending doesn't tell, is
looked up by workers in mapped arrays, which executors write in parts.

Defined results: null texts stay null; empty texts and documents without entities stay
as they are, to the byte; very long texts are handled whole; repeated rows get equal
texts; where patterns overlap, the first and then the longest mention counts; an empty
table stays empty; whatever columns there are stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import SCHEMA, by_part, exchange, pack
from .shared import Scratch, map_array, put_array
from .textops import pieces

KEY = b"textloom"

_TITLES = {"m": "Mr Mister Sir Herr Señor Sr Monsieur Г-н Господин Κύριος".split(), "f": "Mrs Ms Miss Madam Frau Señora Sra Madame Mme Mlle Г-жа Госпожа Κυρία".split(), "x": "Dr Prof Professor".split()}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
_UPPER = "[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁΑ-ΩΆ-Ώ]"
_PERSON = rf"(?:(?<=\s)|(?<=^)|(?<=[(\"'„“]))(?P<title>{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?[  ](?P<names>{_UPPER}[\w'’-]+(?:[  ]{_UPPER}[\w'’-]+){{0,2}})"
#: Between the parts of a number: a separator, after signs that decorate a word, if any.
_GAP = "[*#$%&!]{0,3}[ .-]?"
_FIND = re.compile(
    "|".join(
        [
            r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})",
            r"(?P<secret>(?:(?<=token)|(?<=secret)|(?<=password)|(?<=passwd)|(?<=api_key)|(?<=api-key)|(?<=apikey)|(?<=TOKEN)|(?<=SECRET)|(?<=PASSWORD)|(?<=API_KEY)|(?<=Token)|(?<=Secret)|(?<=Password))!{0,2}[ ]?[*#$%&!]{0,3}[ ]?[=:]!{0,2}[*#$%&]{0,3}[ ]?[\"']?(?P<value>[A-Za-z0-9_+/-]{16,}))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))",
            r"(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            rf"(?P<phone>(?<![\w.+-])(?:\+\d{{1,3}}{_GAP}(?:\(\d{{1,4}}\){_GAP})?|\(\d{{2,4}}\){_GAP}|(?=\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?!\w)))\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,4}}(?!\w|-\w|\.\d))",
            r"(?P<national>(?<![\w.+-])0\d{1,4}(?:[ .-]\d{2,4}){2,4}(?!\w|-\w|\.\d))",
            r"(?P<long>(?<![\w.+-])\+\d{8,15}(?!\w))",
            f"(?P<person>{_PERSON})",
        ]
    )
)
#: Documents in which nothing of this occurs hold no entity.
_MAY = r"[\pN@]|(?:" + "|".join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True)) + r")\.?[ \x{a0}]|(?i:token|secret|passw|api.?key)"

def _syllables(onsets: str, vowels: str) -> list[str]:
    return [o + v for o in onsets.split() for v in vowels]


#: Syllables, and endings of male, female and other names.
_SCRIPTS = {
    "latin": (_syllables("b br c d dr f g gr h j k kl l m n p pr r s st t th v w z", "aeiou"), {"m": ["n", "rd", "s", "ck", "m", "ld"], "f": ["na", "lia", "rina", "nelle", "sie", "tte"], "x": ["ner", "ry", "ett", "mow", "son", "ley"]}),
    "cyrillic": (_syllables("б бр в г д з к кл л м н п пр р с ст т ф", "аеио"), {"m": ["й", "н", "р", "л", "м"], "f": ["на", "ла", "ра", "ия", "ша"], "x": ["ко", "ич", "ук", "ян"]}),
    "greek": (_syllables("β γ δ ζ θ κ λ μ ν π ρ σ στ τ φ χ", "αειο"), {"m": ["ος", "ης", "ας"], "f": ["να", "λη", "νια"], "x": ["ίδης", "άκης", "νου"]}),
}
_GENDERS = "mfx"
#: Draws after which a surrogate gets longer.
GROW = 8


def script_of(form: str) -> str:
    return "cyrillic" if re.search("[а-яё]", form) else "greek" if re.search("[α-ωά-ώ]", form) else "latin"


def ending_gender(form: str) -> str:
    """Gender by a name's ending; x where it doesn't tell."""
    s = script_of(form)
    if s == "latin":
        return "x"
    return "f" if form[-1] in ("ая" if s == "cyrillic" else "αάηήώω") else "m"


def _stream(key: bytes, kind: str, form: str, attempt: int):
    """Endless numbers that depend on the key, the kind, the form and the attempt."""
    n = 0
    while True:
        for b in np.frombuffer(hashlib.blake2b(f"{kind}\0{form}\0{attempt}\0{n}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest(), np.uint32).tolist():
            yield b
        n += 1


def _like(text: str, r, digits: str = "") -> str:
    """Each letter and digit replaced by one of its script and case; the rest stays. ``digits``: what digits may become."""
    out = []
    for c in text:
        x = next(r)
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + (int(digits[x % len(digits)]) if digits else x % 10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + x % 26))
        elif "A" <= c <= "Z":
            out.append(chr(65 + x % 26))
        elif "а" <= c <= "я":
            out.append(chr(ord("а") + x % 32))
        elif "А" <= c <= "Я":
            out.append(chr(ord("А") + x % 32))
        elif "α" <= c <= "ω":
            out.append("αβγδεζηθικλμνξοπρστυφχψω"[x % 24])
        elif "Α" <= c <= "Ω":
            out.append("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"[x % 24])
        elif c.isalpha():
            out.append("aeiounrstl"[x % 10].upper() if c.isupper() else "aeiounrstl"[x % 10])
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(kind: str, form: str, attempt: int = 0, key: bytes = KEY, gender: str | None = None) -> str:
    """The surrogate of an entity's canonical form, in canonical form too; an e-mail's keeps the real domain, whose own surrogate takes its place. Later attempts draw others, longer ones from GROW on."""
    r = _stream(key, kind, form, attempt)
    more = lambda signs: "".join(signs[next(r) % len(signs)] for _ in range(max(0, attempt - GROW + 1)))
    if kind == "email":
        local, _, domain = form.rpartition("@")
        return f"{_like(local, r)}{more(_LETTERS)}@{domain}"
    if kind == "domain":
        labels = form.split(".")
        own = [_like(x, r) for x in labels[:-2]] or [_like(labels[0], r)]
        return f"{'.'.join(own)}{more(_LETTERS)}.example.{labels[-1] if labels[-1] in ('com', 'org', 'net') else 'com'}"
    if kind == "ip":
        octets = []
        for o in form.split("."):
            n = len(o) if attempt < GROW else 3
            lo, hi = ((0, 9), (10, 99), (100, 255))[n - 1]
            octets.append(str(lo + next(r) % (hi - lo + 1)))
        return ".".join(octets) + ("." + more("0123456789") if attempt >= 4 * GROW else "")
    if kind == "ip6":
        return "".join(c if c == ":" else _HEX[next(r) % 16] for c in form) + more(_HEX)
    if kind == "card":
        body = form[0] + _like(form[1:-1], r) + more("0123456789")
        return body + (str((10 - luhn(body + "0")) % 10) if luhn(form) == 0 else str(next(c for c in (x % 10 for x in r) if luhn(body + str(c)) != 0)))
    if kind == "phone":
        head = form[: len(form) - 10] if form[0] == "+" and len(form) > 11 else form[:1] if form[0] in "+0" else ""
        return head + _like(form[len(head) :], r) + more("0123456789")
    if kind == "ssn":
        return f"9{next(r) % 100:02d}{1 + next(r) % 99:02d}{1 + next(r) % 9999:04d}" + more("0123456789")
    if kind == "iban":
        body = _like(form[4:], r) + more("0123456789")
        return form[:2] + f"{98 - _mod97(form[:2] + '00' + body):02d}" + body if _mod97(form) == 1 else form[:2] + _like(form[2:4], r) + body
    if kind == "secret":
        signs = _HEX if re.fullmatch("[0-9a-f]+", form) else _HEX.upper() if re.fullmatch("[0-9A-F]+", form) else ""
        return ("".join(signs[next(r) % 16] for _ in form) if signs else _like(form, r)) + more("0123456789")
    parts, ends = _SCRIPTS[script_of(form)]
    size = max(2, min(4, len(form) // 2)) + attempt // 4
    name = "".join(parts[next(r) % len(parts)] for _ in range(size))
    e = ends[gender or ending_gender(form)]
    return name + e[next(r) % len(e)]


_LETTERS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _case(pattern: str, text: str) -> str:
    if pattern.isupper() and len(pattern) > 1:
        return text.upper()
    if pattern[:1].isupper():
        return text[:1].upper() + text[1:]
    return text


def _fill(mention: str, form: str, keep: str = "") -> str:
    """``form``'s signs in the places of the mention's letters and digits; other signs stay."""
    out, i = [], 0
    for c in mention:
        if c.isalnum() or c in keep:
            d = form[i] if i < len(form) else ""
            i += 1
            out.append(chr(ord(c) - int(c) + int(d)) if c.isdecimal() and d.isdecimal() else d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out) + form[i:]


def _ascii_digits(text: str, keep: str = "") -> str:
    return "".join(str(int(c)) if c.isdecimal() else c for c in text if c.isdecimal() or c in keep or c.isalpha())


_NUMBERS = ("email", "ip", "ip6", "ssn", "card", "phone", "national", "long", "iban")


def _name_parts(word: str, at: int):
    """(start, stop, form) of the parts of a name that get surrogates."""
    found = list(re.finditer(r"[^\W\d_]+", word))
    for m in found:
        if len(found) == 1 or len(m.group()) > 2:
            yield at + m.start(), at + m.end(), m.group().lower()


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, kind, canonical form, gender) of each mention, in order. Gender: what an honorific says of a given name, else x."""
    out, names = [], set()
    for m in _FIND.finditer(text):
        kind = m.lastgroup if m.lastgroup in _NUMBERS else "secret" if m.group("secret") else "person"
        a, b = m.span()
        t = m.group()
        if kind == "email":
            out.append((a, b, kind, t.lower(), "x"))
        elif kind == "secret":
            a, b = m.span("value")
            if any(c.isdigit() for c in text[a:b]):
                out.append((a, b, kind, text[a:b], "x"))
        elif kind == "iban":
            out.append((a, b, kind, t.replace(" ", ""), "x"))
        elif kind == "ip":
            out.append((a, b, kind, t, "x"))
        elif kind == "ip6":
            out.append((a, b, kind, t.lower(), "x"))
        elif kind in ("ssn", "card"):
            out.append((a, b, kind, _ascii_digits(t), "x"))
        elif kind in ("phone", "national", "long"):
            d = _ascii_digits(t, "+")
            n = sum(c.isdigit() for c in d)
            if 10 <= n <= 15 and (kind != "national" or n <= 11) or (7 <= n and (t[0] in "+(")):
                out.append((a, b, "phone", d, "x"))
        else:
            at = m.start("names")
            spans = list(re.finditer(r"[\w'’-]+", m.group("names")))
            spans = [x for i, x in enumerate(spans) if all(y.group()[0].isupper() for y in spans[: i + 1])]
            for i, x in enumerate(spans):
                gender = "x" if i == len(spans) - 1 else _GENDER[m.group("title")]
                for c, d, form in _name_parts(x.group(), at + x.start()):
                    out.append((c, d, "name", form, gender))
                    names |= {text[c:d], text[c:d].upper()} if d - c > 1 else set()
    if names:
        taken = [(a, b) for a, b, *_ in out]
        again = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, sorted(names, key=lambda x: (-len(x), x))))})(?![^\W\d_])")
        i = 0
        more = []
        for m in again.finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or b <= taken[i][0]:
                more.append((a, b, "name", m.group().lower(), "x"))
        out = sorted(out + more)
    return out


def rewritten(text: str, found: list[tuple[int, int, str, str, str]], drawn, key: bytes = KEY) -> str:
    """``drawn``: attempt and gender of a kind and form."""
    out, at = [], 0
    new = lambda kind, form: surrogate(kind, form, *_both(drawn(kind, form), key))
    for a, b, kind, form, _ in found:
        s, mention = new(kind, form), text[a:b]
        if kind == "email":
            local, _, domain = s.rpartition("@")
            s = f"{local}@{new('domain', domain)}"
            s = s.upper() if mention.isupper() else s
        elif kind in ("card", "ssn", "iban"):
            s = _fill(mention, s)
        elif kind == "ip6":
            s = s.upper() if mention.isupper() else s
        elif kind == "phone":
            s = _fill(mention, s.lstrip("+")) if mention[0] != "+" else "+" + _fill(mention[1:], s.lstrip("+"))
        elif kind == "name":
            s = _case(mention, s)
        out += [text[at:a], s]
        at = b
    return "".join(out) + text[at:]


def _both(drawn: tuple[int, str | None], key: bytes) -> tuple[int, bytes, str | None]:
    return drawn[0], key, drawn[1]


def _rows(batch: pa.RecordBatch, column: int) -> list[int]:
    c = batch.column(column)
    c = c.cast(pa.string()) if not pa.types.is_string(c.type) else c
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(c, _MAY), False).to_numpy(zero_copy_only=False)).tolist()


def _distinct(batches):
    seen: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for i in _rows(batch, 0):
            for _, _, kind, form, gender in entities(batch.column(0)[i].as_py()):
                n = seen.setdefault((kind, form), [0, 0])
                if gender != "x":
                    n[gender == "f"] += 1
                if kind == "email":
                    seen.setdefault(("domain", form.rpartition("@")[2]), [0, 0])
        if len(seen) > 200_000:
            yield _pairs(seen)
            seen = {}
    if seen:
        yield _pairs(seen)


def _pairs(seen: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
    rows = sorted(seen)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)] + [pa.array([seen[r][i] for r in rows], pa.int64()) for i in (0, 1)], ["kind", "form", "m", "f"])


def _gendered(batches):
    """Gender of each entity: of most honorifics, else of its ending."""
    for b in batches:
        kind, form, m, f = (b.column(i).to_pylist() for i in range(4))
        g = [None if k != "name" else "m" if x > y else "f" if y > x else ending_gender(t) for k, t, x, y in zip(kind, form, m, f, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g, pa.string())], ["kind", "form", "gender"])


def _draw(key: bytes):
    def run(batches):
        for b in batches:
            k, f, g, n = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(kind, form, i, key, gender) for kind, form, gender, i in zip(k, f, g, n, strict=True)], pa.string())], ["kind", "form", "gender", "attempt", "surrogate"])

    return run


def _code(kind: str, form: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{form}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def assign(spark: SparkSession, texts: DataFrame, key: bytes, s: Scratch) -> DataFrame:
    """(kind, form, gender, attempt, surrogate) of every entity of the corpus; distinct within each kind and none a real entity."""
    shape = "kind string, form string, gender string, attempt int, surrogate string"
    seen = texts.mapInArrow(_distinct, "kind string, form string, m long, f long").groupBy("kind", "form").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    known = s.table(seen.mapInArrow(_gendered, "kind string, form string, gender string"), "entities")
    drawn = s.table(known.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), shape), "drawn0")
    n = 0
    real = known.select(F.col("kind").alias("_kind"), F.col("form").alias("_form"))
    while True:
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "form")
        marked = drawn.withColumn("_nth", F.row_number().over(first))
        clash = marked.join(real, (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_form")), "left").withColumn("_bad", (F.col("_nth") > 1) | F.col("_form").isNotNull())
        n += 1
        marked = s.table(clash.select("kind", "form", "gender", "attempt", "surrogate", "_bad"), f"checked{n}")
        if marked.where("_bad").isEmpty():
            return marked.drop("_bad")
        again = marked.where("_bad").select("kind", "form", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_draw(key), shape)
        drawn = s.table(marked.where("NOT _bad").drop("_bad").unionByName(again), f"drawn{n}")


#: Exceptions in one file.
EXCEPTIONS = 1_000_000


def _part(codes: np.ndarray, n: int) -> np.ndarray:
    return (((codes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _coded(n: int):
    def run(batches):
        for b in batches:
            kind, form, gender, attempt = (b.column(i).to_pylist() for i in range(4))
            rows = [(_code(k, f), a * 4 + _GENDERS.find(g or "x")) for k, f, g, a in zip(kind, form, gender, attempt, strict=True) if a or k == "name" and g != ending_gender(f)]
            if rows:
                code, value = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
                part = _part(code, n)
                order = np.argsort(part, kind="stable")
                yield pack(part[order], [code[order], value[order]])

    return run


def _exceptions(spark: SparkSession, assigned: DataFrame, s: Scratch) -> int:
    """Sorted arrays of the entities that drew again or whose gender the ending doesn't tell, in files by the code's range; how many files."""
    where, n = s.uri, max(1, -(-assigned.where("attempt > 0 OR kind = 'name'").count() // EXCEPTIONS))

    def write(batches):
        for part, payloads in by_part(batches):
            rows = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in payloads]
            code, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            order = np.argsort(code)
            put_array(f"{where}/exceptions-{part}.npy", np.stack((code[order], value[order])))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    coded = assigned.select("kind", "form", "gender", "attempt").mapInArrow(_coded(n), SCHEMA)
    s.table(exchange(coded, n).mapInArrow(write, "part int"), "exceptions")
    put_array(f"{where}/complete.npy", np.array([n]))
    return n


_loaded: dict[str, dict[int, np.ndarray | None]] = {}


def _attempts(where: str, n: int):
    if where not in _loaded:
        map_array(f"{where}/complete.npy")  # fails where the folder isn't shared
        _loaded.clear()
        _loaded[where] = {}
    files = _loaded[where]

    def drawn(kind: str, form: str) -> tuple[int, str | None]:
        code = _code(kind, form)
        part = (code >> 32) * n >> 32
        if part not in files:
            try:
                files[part] = map_array(f"{where}/exceptions-{part}.npy")
            except FileNotFoundError:  # no exception in this range
                files[part] = None
        a = files[part]
        if a is None:
            return 0, None
        i = int(np.searchsorted(a[0], np.uint64(code)))
        if i == a.shape[1] or a[0, i] != code:
            return 0, None
        return int(a[1, i]) >> 2, _GENDERS[int(a[1, i]) & 3] if kind == "name" else None

    return drawn


def pseudonymise(spark: SparkSession, docs: DataFrame, key: bytes = KEY, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` (and ``n_chars`` set anew in rows that changed)."""
    s = scratch or Scratch(spark, "pii")
    text = docs.select(F.col("text").cast("string").alias("text"))
    files = _exceptions(spark, assign(spark, text, key, s), s)
    where, names, schema = s.uri, docs.columns, docs.schema
    t, c = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        drawn = _attempts(where, files)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                changed = []
                for i in _rows(part, t):
                    if found := entities(texts[i]):
                        texts[i] = rewritten(texts[i], found, drawn, key)
                        changed.append(i)
                if not changed:
                    yield part
                    continue
                columns = list(part.columns)
                columns[t] = pa.array(texts, part.schema.field(t).type)
                if c >= 0:
                    n = part.column(c).to_pylist()
                    for i in changed:
                        n[i] = len(texts[i])
                    columns[c] = pa.array(n, part.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)
