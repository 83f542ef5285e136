"""Secret scan: fixed patterns, plus a linear-chain conditional random field over tokens.

Tokens are runs of non-space characters, tagged begin, inside or outside from their shape, their neighbours' words and figures of the
whole text. The weights are fitted by gradient ascent on the conditional log-likelihood of seeded, generated sequences, a bounded number
of them, so they do not depend on the corpus. Decoding is Viterbi's, of every token of a text. Most tokens are seen to be outside on every
best path by bounds on what the tokens before and after them can add for another tag; there the chain falls apart, and only the runs
between them are decoded step by step, which gives what decoding the whole chain gives.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the runs of 24 or more

_TRIGGER = re.compile(r"\S*[0-9=+/_]\S*|-----\S*")
_TOKEN = re.compile(r"\S+")
_ASSIGN_HINT = ("passw", "secret", "token", "apikey", "api_key")

#: Words before a token that make a secret likely, and those that make it unlikely.
LURES = frozenset(("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "bearer", "credential", "credentials", "passphrase", "auth", "authorization"))
DULL = frozenset(("commit", "sha", "sha256", "md5", "revision", "hash", "version", "id", "page", "tel", "phone", "call", "isbn", "order"))

FEATURES = (
    "bias", "plain", "len4", "len8", "len16", "len24", "len40", "digits", "lower_upper_digit", "lower_digit", "upper_digit", "hex", "base64", "diverse", "assign", "assign_lure", "url", "email", "numeric", "dash_block",
    "known_prefix", "letters_cased", "letters_dashed", "told", "prev_lure", "prev2_lure", "prev_dull", "next_lure", "prev_plain", "next_plain", "prev_dash", "next_dash", "doc_dense", "doc_base", "doc_plain",
)
_AT = {f: k for k, f in enumerate(FEATURES)}
_EDGE = "\"'`,;:.!?()[]{}<>"
_CASED = re.compile(r"[^\W\d_]*[a-z][A-Z]")
_DASHED = re.compile(r"\w+(-\w+){2,}")
_LENGTHS = (("len4", 4), ("len8", 8), ("len16", 16), ("len24", 24), ("len40", 40))
#: Words that stand between a lure and what it names.
_LINKS = frozenset(("is", "was", ":", "=", "ist", "lautet", "est", "es"))
_PREFIX = re.compile(r"(AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_\w{20,}|sk[-_]\w{16,}|eyJ[\w-]{10,}|xox[abps]-|AIza[\w-]{20,}|glpat-")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HEXED = re.compile(r"[0-9a-fA-F]{16,}")
#: The name before the value that a pattern finds, and, of an assignment, the first part of the name.
_NAME = (re.compile(r"""(?:[A-Za-z_][\w.-]*["']?[=:]["']?)?\Z"""), re.compile(r"""(?:(?<!\S)["']?[A-Za-z_][\w.-]*)?\Z"""))
_VALUE = re.compile(r"""([A-Za-z_][\w.-]*)["']?[=:]["']?(\S{6,})""")


@lru_cache(1 << 15)
def own(token: str) -> tuple[int, ...]:
    """Features of a token by itself."""
    t = token.strip(_EDGE)
    f = ["bias"]
    if t.isalpha() or not t or not re.search(r"[0-9=+/_]|-----", t):
        f += ["plain", *(x for x, least in _LENGTHS if len(t) >= least), *["letters_cased"] * bool(_CASED.match(t)), *["letters_dashed"] * bool(_DASHED.fullmatch(t))]
        return tuple(_AT[x] for x in f)
    if m := _VALUE.fullmatch(t):
        f.append("assign")
        if any(w in LURES for w in re.split(r"[_.-]", m[1].lower())) or m[1].lower() in LURES:
            f.append("assign_lure")
        t = m[2].strip(_EDGE)
    n = len(t)
    f += [x for x, least in _LENGTHS if n >= least]
    low, up, dig = (any(map(p, t)) for p in (str.islower, str.isupper, str.isdigit))
    if dig:
        f.append("digits")
        f += ["lower_upper_digit"] * (low and up) + ["lower_digit"] * (low and not up) + ["upper_digit"] * (up and not low) + ["numeric"] * (not low and not up)
    f += ["hex"] * bool(_HEXED.fullmatch(t)) + ["base64"] * bool(_B64.fullmatch(t)) + ["diverse"] * (n >= 12 and len(set(t)) >= 0.45 * min(n, 32))
    f += ["url"] * ("://" in t or t.startswith("www.")) + ["email"] * ("@" in t) + ["dash_block"] * ("-----" in token) + ["known_prefix"] * bool(_PREFIX.match(t))
    return tuple(_AT[x] for x in f)


def _word(token: str) -> str:
    return token.strip(_EDGE + "=").lower()


_LURE, _DULL, _PLAIN, _DASH, _NAMES, _LINK = (1 << k for k in range(6))


@lru_cache(1 << 15)
def marks(token: str) -> int:
    """What a token tells its neighbours, as bits."""
    word = _word(token)
    lure = word in LURES
    return _LURE * lure | _DULL * (word in DULL) | _PLAIN * (_AT["plain"] in own(token)) | _DASH * ("-----" in token) | _NAMES * (lure and token[-1] in ":=") | _LINK * (token in _LINKS)


def _before(last: int, second: int) -> list[int]:
    """Features that the marks of the token before and of the one before that give."""
    out = [_AT[x] for x, bit in (("prev_lure", _LURE), ("prev_plain", _PLAIN), ("prev_dash", _DASH), ("prev_dull", _DULL)) if last & bit]
    return out + [_AT["prev2_lure"]] * bool(second & _LURE) + [_AT["told"]] * bool(last & _NAMES or last & _LINK and second & _LURE)


def _after(mark: int) -> list[int]:
    return [_AT[x] for x, bit in (("next_lure", _LURE), ("next_plain", _PLAIN), ("next_dash", _DASH)) if mark & bit]


def described(tokens: list[str], k: int, file: tuple[int, ...]) -> list[int]:
    """Indices of the active features of tokens[k]; file: those of the whole text."""
    last, second = marks(tokens[k - 1]) if k else 0, marks(tokens[k - 2]) if k > 1 else 0
    return [*own(tokens[k]), *file, *_before(last, second), *(_after(marks(tokens[k + 1])) if k + 1 < len(tokens) else ())]


def file_features(n_tokens: int, n_triggers: int, n_base: int) -> tuple[int, ...]:
    out = ["doc_dense"] * (10 * n_triggers > n_tokens) + ["doc_base"] * (n_base > 0) + ["doc_plain"] * (100 * n_triggers < n_tokens)
    return tuple(_AT[x] for x in out)


def examples(count: int, seed: int = 5) -> list[tuple[list[str], list[int], tuple[int, ...]]]:
    """Generated sequences: tokens, labels (0 outside, 1 begin, 2 inside) and features of the text they would stand in."""
    r = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def rand(alphabet: str, a: int, b: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))

    def word() -> str:
        w = rand(letters, 1, 11)
        return r.choice((w, w, w, w.title(), w + ",", w + ".", r.choice(sorted(LURES | DULL))))

    def camel(a: int, b: int) -> str:
        return "".join(rand(letters, 3, 8).title() for _ in range(r.randint(a, b)))

    def dashed(a: int, b: int) -> str:
        return "-".join(rand(letters, 2, 8) for _ in range(r.randint(a, b)))

    cased = letters + letters.upper()
    mixed = cased + digits
    out = []
    for _ in range(count):
        tokens, labels = [], []

        def put(*items: str, label: int = 0) -> None:
            tokens.extend(items)
            labels.extend([label] * len(items))

        put(*(word() for _ in range(r.randint(1, 4))))
        kind = r.randrange(26)
        if kind == 0:
            put(r.choice(("password", "passphrase", "pwd", "secret")), r.choice(("is", "was", ":", "=")))
            put(rand(mixed + "_+", 10, 20) + r.choice(digits), label=1)
        elif kind == 1:
            put(r.choice(("Bearer", "Authorization", "token", "key")))
            put(rand(r.choice((mixed, mixed, digits + "abcdef")), 24, 60), label=1)
        elif kind == 2:
            put(r.choice(("ghp_", "sk-", "eyJ", "glpat-")) + rand(r.choice((mixed, letters + digits)), 24, 40) + r.choice(digits), label=1)
        elif kind == 3:
            put(r.choice(("client_secret", "db_password", "AUTH_TOKEN", "my-api-key", "secret_key")) + r.choice("=:") + rand(mixed, 12, 32) + r.choice(digits), label=1)
        elif kind == 4:
            put("-----BEGIN", "RSA", "PRIVATE", "KEY-----")
            put(rand(mixed + "+/", 48, 64), label=1)
            put(*(rand(mixed + "+/", 48, 64) for _ in range(r.randint(0, 3))), label=2)
            put(rand(r.choice((mixed + "+/", cased)), 4, 64), label=2)
            put("-----END", "RSA", "PRIVATE", "KEY-----")
        elif kind == 5:
            put("AKIA" + rand(letters.upper() + digits, 16, 16), label=1)
        elif kind in (6, 7):
            put(rand(letters, 3, 9) + "." + rand(digits, 1, 2) + "@" + rand(letters, 4, 8) + ".example.com")
        elif kind == 8:
            put(".".join(str(r.randrange(256)) for _ in range(4)), "+" + rand(digits, 2, 2) + "-" + rand(digits, 6, 10))
        elif kind == 9:
            put("https://www." + rand(letters, 4, 9) + ".example/" + rand(letters + digits, 4, 30) + "?" + rand(letters, 2, 5) + "=" + rand(digits, 1, 5))
        elif kind == 10:
            put(r.choice(("commit", "sha256", "md5", "hash", "revision")), rand(digits + "abcdef", 32, 64))
        elif kind == 11:
            put(rand(digits, 1, 12), rand(letters, 2, 6) + rand(digits, 1, 4))
        elif kind == 12:
            put(rand(letters, 2, 8) + "=" + rand(letters, 2, 8), "/".join(rand(letters, 3, 8) for _ in range(3)), rand(letters, 2, 6) + "_" + rand(letters, 2, 6))
        elif kind == 13:
            put(r.choice(("password", "token", "secret", "key")), word(), word())
        elif kind == 14:
            put(*r.choice((("password", "is"), ("passphrase", "was"), ("password:",), ("passphrase:",), ("pwd", "="), ("secret:",), ("secret", ":"))))
            put(r.choice((camel, dashed))(3, 5) if r.randrange(4) else rand(r.choice((cased, letters)), 16, 40), label=1)
        elif kind == 15:
            put(r.choice(("Bearer", "Authorization:", "token:", "key", "token")))
            put(rand(r.choice((cased, cased, letters)), 24, 60), label=1)
        elif kind == 16:
            put(r.choice((camel, dashed))(2, 4), word(), rand(r.choice((cased, letters)), 12, 60))
        elif kind in (17, 19, 24, 25):
            put(*r.choice((("password", "is"), ("key", "is"), ("token", "was"), ("password:",), ("passphrase:",), ("pwd", "is"), ("secret", ":"))), rand(letters, 1, 13), *(word() for _ in range(r.randrange(3))))
        elif kind in (20, 21):
            put(*r.choice((("password", "is"), ("the", "key", "is"), ("passphrase:",), ("pwd", "="), ("the", "password", "was"), ("token", "is"))))
            put(rand(letters, 3, 10) + rand(digits, 1, 4), label=1)
        elif kind in (22, 23):
            put(*r.choice((("the", "password", "is"), ("passphrase", "was"), ("password:",), ("the", "passphrase", "is"), ("secret:",))))
            put(r.choice((camel(2, 4), "".join(rand(letters, 2, 6).title() for _ in range(r.randint(3, 5))), rand(letters, 16, 36))), label=1)
        elif kind == 18:
            put(r.choice(("key", "token", "secret", "password")), r.choice((camel, dashed))(2, 3))
        put(*(word() for _ in range(r.randint(0, 4))))
        out.append((tokens, labels, file_features(r.choice((20, 400)), r.choice((1, 3)), r.randrange(2))))
    return out


class ChainModel:
    """Emission weights (features x 3) and transition weights (3 x 3) of tags outside, begin, inside."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step
        self.gain = emit[:, 1:] - emit[:, :1]
        self.room = [max(0.0, (step[:, t] - step[:, 0]).max()) + max(0.0, (step[t] - step[0]).max()) + 1e-6 for t in (1, 2)]
        bits = range(1 << 6)
        self.before = np.array([[self.gain[_before(m, n)].sum(0) for n in bits] for m in bits])
        self.after = np.array([self.gain[_after(m)].sum(0) for m in bits])
        #: Classes of tokens: own features and marks, numbered as they come; what a class gains by itself, its marks.
        self.classes: dict[tuple[tuple[int, ...], int], int] = {}
        self.known = _Classes(self.classes)
        self.own_gain, self.mark = np.zeros((0, 2)), np.zeros(0, int)

    def viterbi(self, active: list[list[int]], after_outside: bool = False, before_outside: bool = False) -> list[int]:
        """The best path; after_outside, before_outside: the token before the first, after the last, is outside."""
        score, back = self.emit[active[0]].sum(0) + self.step[0] * after_outside, []
        for f in active[1:]:
            total = score[:, None] + self.step
            back.append(total.argmax(0))
            score = total.max(0) + self.emit[f].sum(0)
        path = [int((score + self.step[:, 0] * before_outside).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def gains(self, kinds: np.ndarray, file: tuple[int, ...]) -> np.ndarray:
        """(2 x tokens) what tags begin and inside gain over outside by the features alone; kinds: the tokens' classes."""
        if len(self.mark) < len(self.classes):
            self.own_gain = np.array([self.gain[list(f)].sum(0) for f, _ in self.classes])
            self.mark = np.array([m for _, m in self.classes])
        m = self.mark[kinds]
        last, second, coming = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
        last[1:], second[2:], coming[:-1] = m[:-1], m[:-2], m[1:]
        return (self.own_gain[kinds] + self.before[last, second] + self.after[coming] + self.gain[list(file)].sum(0)).T

    def open_tokens(self, gains: np.ndarray) -> np.ndarray:
        """Positions of the tokens that are not sure to be outside on every best path.

        Whatever tags a path has before and after a token, changing the token's tag to outside loses at most self.room by transitions.
        """
        return np.flatnonzero((gains[0] >= -self.room[0]) | (gains[1] >= -self.room[1]))


class _Classes(dict):
    """Token to the number of its class; cleared by the caller when it has grown long."""

    def __init__(self, classes: dict[tuple[tuple[int, ...], int], int]):
        self.classes = classes

    def __missing__(self, token: str) -> int:
        kind = (own.__wrapped__(token), marks.__wrapped__(token))
        self[token] = number = self.classes.setdefault(kind, len(self.classes))
        return number


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(count: int = 2400, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> ChainModel:
    """Adam on the mean conditional log-likelihood; forward and backward sums over all sequences at once."""
    data = examples(count)
    longest = max(len(t) for t, _, _ in data)
    x, y, mask = np.zeros((count, longest, len(FEATURES)), np.float32), np.zeros((count, longest), int), np.zeros((count, longest), bool)
    for n, (tokens, labels, file) in enumerate(data):
        for k in range(len(tokens)):
            x[n, k, described(tokens, k, file)] = 1
        y[n, : len(labels)], mask[n, : len(labels)] = labels, True
    gold = np.eye(3)[y] * mask[..., None]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    emit, step = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    m, v = np.zeros(emit.size + 9), np.zeros(emit.size + 9)
    for k in range(1, rounds + 1):
        e = (x @ emit.astype(np.float32)).astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _log_sum(alpha[:, t - 1, :, None] + step, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _log_sum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _log_sum(alpha[:, -1], 1)
        seen = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g_emit = np.einsum("ntf,nti->fi", x, (gold - seen).astype(np.float32)) / count - ridge * emit
        g = np.concatenate((g_emit.ravel(), ((gold_step - pair.sum((0, 1))) / count - ridge * step).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        emit += move[: emit.size].reshape(emit.shape)
        step += move[emit.size :].reshape(3, 3)
    return ChainModel(emit, step)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    low = text.lower()
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in _ASSIGN_HINT) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def model_spans(text: str, model: ChainModel, base: list[tuple[int, int, int]], whole: bool = False) -> list[tuple[int, int, int]]:
    """Spans the model tags, trimmed of enclosing punctuation, less the patterns' spans.

    whole: decode every token step by step; otherwise only those that bounds leave open, which gives the same spans.
    """
    tokens = text.split()
    if not tokens:
        return []
    hits = sum(1 for _ in _TRIGGER.finditer(text))
    file = file_features(len(tokens), hits, len(base))
    if whole:
        runs = [(0, len(tokens))]
    else:
        if len(model.known) > 1 << 17:
            model.known.clear()
        known = model.known
        kinds = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
        at = model.open_tokens(model.gains(kinds, file))
        if not len(at):
            return []
        cuts = np.flatnonzero(np.diff(at) > 1)
        runs = list(zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + 1).tolist(), strict=True))
    tagged = []
    for begin, end in runs:
        tags = model.viterbi([described(tokens, k, file) for k in range(begin, end)], begin > 0, end < len(tokens))
        k = 0
        while k < len(tags):
            if tags[k]:
                last = k
                while last + 1 < len(tags) and tags[last + 1] == 2:
                    last += 1
                tagged.append((begin + k, begin + last))
                k = last
            k += 1
    if not tagged:
        return []
    edges = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = []
    for k, last in tagged:
        a, b = edges[k][0], edges[last][1]
        if last == k:
            a, b = _trimmed(text, a, b, _EDGE)
        if a < b:
            out += [(x, y, 3) for x, y in _rest(text, a, b, base)]
    return out


def _trimmed(text: str, a: int, b: int, edge: str) -> tuple[int, int]:
    body = text[a:b]
    return a + len(body) - len(body.lstrip(edge)), b - (len(body) - len(body.rstrip(edge)))


def _rest(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the patterns' spans leave of text[a:b], trimmed; a name that leads up to a pattern's span within a token is no secret."""
    at = a
    for x, y, kind in sorted(s for s in base if a < s[1] and s[0] < b):
        if at < x:
            end = x - len(_NAME[kind == 0].search(text, max(at, x - 64), x)[0])
            yield from _piece(text, at, end)
        at = max(at, y)
    if at == a:
        yield a, b
    elif at < b:
        yield from _piece(text, at, b)


def _piece(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    a, b = _trimmed(text, a, b, _EDGE + "=" + string.whitespace)
    if any(map(str.isalnum, text[a:b])):
        yield a, b


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], s[2])))


def _scan(model: ChainModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = base + model_spans(text, model, base)
                counts = [sum(s[2] == k for s in base) for k in range(3)]
                rows.append((*counts, _joined(base), _joined(every)))
            columns = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", "n_assign", "n_access", "n_hex", "base", "spans"])

    return run


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", model: ChainModel | None = None) -> DataFrame:
    """key, n_assign, n_access, n_hex, base, spans for every row: counts of the patterns' matches, their spans, and all spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then kind, joined by commas. A null or empty text has none
    (zeros and empty strings). Null keys and repeated rows are kept. An empty table gives no rows. Other columns are not read.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return rows.mapInArrow(_scan(model or fit()), "key long, n_assign long, n_access long, n_hex long, base string, spans string").withColumnRenamed("key", key)


def redacted(text: str, model: ChainModel) -> str:
    """text with every secret span replaced by its kind in brackets; of spans that overlap, the first by start, then the longest."""
    base = base_spans(text)
    at, parts = 0, []
    for a, b, kind in sorted(base + model_spans(text, model, base), key=lambda s: (s[0], -s[1])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def redact_secrets(docs: DataFrame, text: str = "text", model: ChainModel | None = None) -> DataFrame:
    """docs with every secret span replaced by its kind in brackets; only the texts go to Python.

    All rows and columns stay, whatever their names; null and empty texts, and those without secrets, stay as they are. An empty table
    gives no rows.
    """
    model = model or fit()

    @F.arrow_udf("string")
    def redact(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([x and redacted(x, model) for x in column.to_pylist()], pa.string())

    return bounded(docs).withColumn(text, redact(docs[text]))
