"""PII: a character-level bidirectional LSTM with CRF transitions, in numpy, beside base rules.

The base rules find emails, IP addresses, payment cards and phone numbers over whole texts and
always stay. The model adds spans that the rules cannot describe, such as ``name [at] host.org``
or a phone number without its plus. It is fitted here, from windows of a bounded sample of
documents: their base spans and spans put in for training are the labels.

Whole texts are tagged in overlapping windows. Emissions of the windows that cover a character
are averaged, with most weight to the window in whose middle it lies, and one Viterbi pass
decodes every covered stretch as a whole, so no window border cuts a span. A CRF constraint
makes windows cheap: a span holds a digit, ``@`` or a bracketed ``at``, so windows without one
are outside by rule and are not evaluated.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rowdeck.llm.common import first_rows, lean, map_batches, narrow, slices, table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # the look-behind saves retries inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]|[\[({<] ?(?i:at) ?[\])}>]")
AT = re.compile(r"[\[({<] ?(?i:at) ?[\])}>]")

WIDTH, STRIDE = 96, 48
UNITS, EMBED = 16, 12
TAGS = 2 * len(KINDS) + 1  # outside, then begin and inside of each kind
MAX_SAMPLE = 400  # documents whose texts feed the training windows
# Characters with a code of their own; digits share one, as do capitals, small letters, other letters, white space.
MARKS = "@.-+()[]{}<>_%,:;/*#=\"'&$"


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = [part.lstrip("0") for part in text.split(".")]  # a part may have any number of zeros in front
        return all(len(part) <= 3 and int(part or "0") <= 255 for part in parts)
    if kind == "card":
        digits = only_digits(text)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(only_digits(text)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", start, end) for start, end in _emails(text)]
    for kind, rule, needs in (("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
        if needs in text:
            found += [(kind, m.start(), m.end()) for m in rule.finditer(text) if valid(kind, m[0])]
    return found


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL in linear time: only the run of name characters before an ``@`` can start one."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in NAME:
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return found


NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _code_table() -> np.ndarray:
    codes = np.full(256, 5, np.int64)
    for c in range(256):
        char = chr(c)
        if char.isascii() and char.isdigit():
            codes[c] = 0
        elif char in MARKS:
            codes[c] = 32 + MARKS.index(char)
        elif char.isspace():
            codes[c] = 1
        elif char.isascii() and char.isalpha():
            codes[c] = 6 + ord(char.lower()) - ord("a")
        elif char.isalpha():
            codes[c] = 2
    return codes


CODES = _code_table()
N_CODES = 32 + len(MARKS) + 1
PAD = N_CODES - 1


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODES[np.minimum(points, 255)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, forward and backward LSTM, linear emissions, CRF transitions."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"E": draw(N_CODES, EMBED), "O": draw(2 * UNITS, TAGS), "o": np.zeros(TAGS, np.float32), "T": draw(TAGS, TAGS) * 0.1}
        for side in "fb":
            self.p |= {f"W{side}": draw(EMBED, 4 * UNITS), f"U{side}": draw(UNITS, 4 * UNITS), f"c{side}": np.zeros(4 * UNITS, np.float32)}
            self.p[f"c{side}"][UNITS : 2 * UNITS] = 1.0
        for a in range(TAGS):
            for b in range(2, TAGS, 2):  # an inside tag follows its own begin or inside only
                if a not in (b - 1, b):
                    self.p["T"][a, b] = -30.0

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, units) of one direction, and what the backward pass needs."""
        steps, batch, _ = x.shape
        into = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((batch, UNITS), np.float32), np.zeros((batch, UNITS), np.float32)
        out, kept = np.empty((steps, batch, UNITS), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = into[t] + h @ self.p[f"U{side}"]
            ifo = _sigmoid(gates[:, : 3 * UNITS])
            i, f, o = ifo[:, :UNITS], ifo[:, UNITS : 2 * UNITS], ifo[:, 2 * UNITS :]
            g = np.tanh(gates[:, 3 * UNITS :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            kept.append((t, i, f, o, g, before, squashed, last))
        return out, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(time, batch, tags) for codes (batch, time)."""
        x = self.p["E"][codes.T]
        hidden = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return hidden @ self.p["O"] + self.p["o"]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags (batch, time) and its gradient."""
        x = self.p["E"][codes.T]
        forward, kept_f = self._run(x, "f")
        backward, kept_b = self._run(x, "b")
        hidden = np.concatenate([forward, backward], axis=2)
        e = hidden @ self.p["O"] + self.p["o"]
        loss, de, dt = self._crf(e, tags.T)
        grads = {"T": dt, "O": np.einsum("tbh,tbk->hk", hidden, de), "o": de.sum((0, 1))}
        dh = de @ self.p["O"].T
        dx = np.zeros_like(x)
        for side, kept, part in (("f", kept_f, dh[..., :UNITS]), ("b", kept_b, dh[..., UNITS:])):
            dx += self._back(x, side, kept, part, grads)
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], codes.T, dx)
        return loss, grads

    def _back(self, x: np.ndarray, side: str, kept: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        w, u = self.p[f"W{side}"], self.p[f"U{side}"]
        du, dgates = np.zeros_like(u), np.empty((*x.shape[:2], 4 * UNITS), np.float32)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t, i, f, o, g, before, squashed, last in reversed(kept):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed**2)
            step = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dgates[t] = step
            du += last.T @ step
            dh, dc = step @ u.T, dc * f
        grads[f"U{side}"], grads[f"c{side}"] = du, dgates.sum((0, 1))
        grads[f"W{side}"] = np.einsum("tbe,tbg->eg", x, dgates)
        return dgates @ w.T

    def _crf(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood per sequence and gradients of emissions and transitions."""
        steps, batch, _ = e.shape
        T, rows = self.p["T"], np.arange(batch)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(T + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        gold = e[np.arange(steps)[:, None], rows, tags].sum(0) + T[tags[:-1], tags[1:]].sum(0)
        de = np.exp(alpha + beta - total[:, None])
        de[np.arange(steps)[:, None], rows, tags] -= 1
        pairs = alpha[:-1, :, :, None] + T + (e[1:] + beta[1:])[:, :, None, :] - total[:, None, None]
        dt = np.exp(pairs).sum((0, 1))
        np.subtract.at(dt, (tags[:-1], tags[1:]), 1)
        return float((total - gold).mean()), (de / batch).astype(np.float32), (dt / batch).astype(np.float32)

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        fixed = self.p["T"] <= -30.0
        rng, step, losses = np.random.default_rng(11), 0, []
        for epoch in range(epochs):
            order, seen = rng.permutation(len(codes)), []
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                loss, grads = self.gradients(codes[rows], tags[rows])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                    self.p[name] = (self.p[name] - rate * 0.7**epoch * change).astype(np.float32)
                self.p["T"][fixed] = -30.0
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi tags of one stretch of emissions (time, tags)."""
        T, best = self.p["T"], e[0].copy()
        best[2::2] = -1e9  # nothing starts inside
        back = np.empty((len(e), TAGS), np.int8)
        for t in range(1, len(e)):
            scores = best[:, None] + T
            back[t] = scores.argmax(0)
            best = scores[back[t], np.arange(TAGS)] + e[t]
        tags = np.empty(len(e), np.int64)
        tags[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def training_windows(texts: list[str], per_text: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows around base spans, and around spans and look-alikes put into the texts, with tags."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(text: str, spans: list[tuple[str, int, int]], middle: int) -> None:
        marks = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            k = 1 + 2 * KINDS.index(kind)
            marks[start], marks[start + 1 : end] = k, k + 1
        start = max(0, middle - WIDTH // 2 + int(rng.integers(-20, 21)))
        window, marked = encode(text[start : start + WIDTH]), marks[start : start + WIDTH]
        marked = np.where((np.arange(len(marked)) == 0) & (marked > 0) & (marked % 2 == 0), marked - 1, marked)
        codes.append(np.pad(window, (0, WIDTH - len(window)), constant_values=PAD))
        tags.append(np.pad(marked, (0, WIDTH - len(marked))))

    for text in texts or ["The quick brown fox sat on the mat and read the news of the day."]:
        known = base_spans(text)
        for _, start, end in known[:per_text] if _apart(known) else []:
            add(text, known, (start + end) // 2)
        for _ in range(per_text):
            at = int(rng.integers(0, len(text) + 1))
            at = text.rfind(" ", 0, at) + 1
            left, right = text[max(0, at - WIDTH) : at], text[at : at + WIDTH]
            kind, piece = _made(rng)
            whole = f"{left}{piece} {right}"
            near = [x for x in base_spans(whole) if x[2] <= len(left) or x[1] >= len(left) + len(piece)]
            if _apart(near):
                add(whole, near + ([(kind, len(left), len(left) + len(piece))] if kind else []), len(left) + len(piece) // 2)
    return np.array(codes), np.array(tags)


def _apart(spans: list[tuple[str, int, int]]) -> bool:
    places = sorted((start, end) for _, start, end in spans)
    return all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def _made(rng: np.random.Generator) -> tuple[str | None, str]:
    """A made-up span of some kind, or a look-alike that is none."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10))))
    name = word() + str(rng.choice(["", ".", "_", "-"])) + str(rng.choice([word(), number(2), ""]))
    host = word() + str(rng.choice(["", number(1)])) + "." + str(rng.choice(["com", "org", "net", "example.com", "de", "co.uk"]))
    at = str(rng.choice([" [at] ", " (at) ", "[at]", "(at)", " {at} ", " <at> "]))
    dot = str(rng.choice([" [dot] ", " (dot) ", "[dot]", "."]))
    made = int(rng.integers(0, 13))
    if made <= 1:
        return "email", f"{name.rstrip('._-')}@{host}"
    if made <= 4:
        return "email", name.rstrip("._-") + at + host.replace(".", dot)
    if made == 5:
        return "ip", ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if made == 6:
        digits = number(15)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return "card", digits if rng.random() < 0.5 else str(rng.choice([" ", "-"])).join(digits[k : k + 4] for k in range(0, 16, 4))
    if made == 7:
        return "phone", f"+{int(rng.integers(1, 99))} ({number(3)}) {number(3)}-{number(4)}"
    if made <= 9:
        return "phone", str(rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(6)}"]))
    if made == 10:
        return None, str(rng.choice([f"version {number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(3)},{number(3)}", f"{number(2)}:{number(2)}"]))
    if made == 11:
        return None, "".join(str(c) for c in rng.choice(list("0123456789abcdef"), 40))
    return None, number(int(rng.integers(1, 8)))


def train(documents: DataFrame, max_sample: int = MAX_SAMPLE) -> Tagger:
    """A tagger fitted on windows of at most ``max_sample`` documents."""
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text").where("text is not null and doc_id is not null")
    ids = first_rows(docs.select("doc_id"), "doc_id", max_sample).distinct()
    sample = docs.join(F.broadcast(ids), "doc_id")
    texts = [row["text"] for row in sorted(sample.collect(), key=lambda row: (row["doc_id"], row["text"]))]
    tagger = Tagger()
    tagger.fit(*training_windows(texts))
    return tagger


def stretches(text: str) -> list[list[int]]:
    """Starts of the windows of a text that hold an anchor, grouped where windows touch."""
    starts = set()
    for match in ANCHOR.finditer(text):
        last = match.start() // STRIDE
        starts.update(k * STRIDE for k in range(max(0, last - WIDTH // STRIDE + 1), last + 1))
    groups: list[list[int]] = []
    for start in sorted(starts):
        if groups and start <= groups[-1][-1] + STRIDE:
            groups[-1].append(start)
        else:
            groups.append([start])
    return groups


WEIGHT = 1.0 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]).astype(np.float32)


HELD_WINDOWS = 4096  # whose emissions are held at once, unless one stretch has more


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Decoded spans of every text that pass the checks of their kind."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    jobs: list[tuple[int, list[int]]] = []
    held = 0
    for k, text in enumerate(texts):
        for group in stretches(text):
            if jobs and held + len(group) > HELD_WINDOWS:
                _decode_stretches(texts, jobs, tagger, out)
                jobs, held = [], 0
            jobs.append((k, group))
            held += len(group)
    if jobs:
        _decode_stretches(texts, jobs, tagger, out)
    return out


def _decode_stretches(texts: list[str], jobs: list[tuple[int, list[int]]], tagger: Tagger, out: list[list[tuple[str, int, int]]]) -> None:
    windows = [(k, start) for k, group in jobs for start in group]
    emissions = np.empty((len(windows), WIDTH, TAGS), np.float32)
    for k in range(0, len(windows), 512):
        part = windows[k : k + 512]
        codes = np.full((len(part), WIDTH), PAD, np.int64)
        for row, (n, start) in enumerate(part):
            piece = encode(texts[n][start : start + WIDTH])
            codes[row, : len(piece)] = piece
        emissions[k : k + len(part)] = tagger.emissions(codes).transpose(1, 0, 2)
    done = 0
    for n, group in jobs:
        text, first = texts[n], group[0]
        size = min(len(text), group[-1] + WIDTH) - first
        total, weight = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        for start in group:
            here = slice(start - first, min(size, start - first + WIDTH))
            length = here.stop - here.start
            total[here] += emissions[done, :length] * WEIGHT[:length, None]
            weight[here] += WEIGHT[:length, None]
            done += 1
        tags = tagger.decode(total / weight)
        (begins,) = np.nonzero(tags % 2 == 1)
        for begin in begins.tolist():
            end = begin + 1
            while end < size and tags[end] == tags[begin] + 1:
                end += 1
            kind, piece = KINDS[(tags[begin] - 1) // 2], text[first + begin : first + end]
            if plausible(kind, piece, text, first + begin, first + end):
                out[n].append((kind, first + begin, first + end))


def plausible(kind: str, piece: str, text: str, start: int, end: int) -> bool:
    """Checks on what the model adds: whole tokens only, and the number rules of the kind."""
    if piece != piece.strip() or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    if kind == "email":
        parts = AT.split(piece) if "@" not in piece else piece.split("@")
        return len(parts) == 2 and all(part.strip() for part in parts) and ("." in parts[1] or "dot" in parts[1].lower()) and piece.count(" ") <= 6
    if kind == "phone":
        return set(piece) <= set("+0123456789 ().-") and valid(kind, piece) and piece != only_digits(piece)
    if kind == "ip":
        return IP.fullmatch(piece) is not None and valid(kind, piece)
    return CARD.fullmatch(piece) is not None and valid(kind, piece)


def merged(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and added ones that overlap none of them, by kind as listed, then start."""
    taken = sorted((start, end) for _, start, end in base)
    kept = [x for x in added if not any(start < x[2] and x[1] < end for start, end in taken)] if added else []
    return sorted(base + kept, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_data(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per document row.

    The counts and the digest are those of the base rules, ``spans`` holds these and the
    model's. NULL and empty texts have no spans; texts of any length are read whole. Repeated
    rows give repeated results, a NULL doc_id is carried through, other columns are ignored, an
    empty table gives no rows.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    tagger = train(documents) if tagger is None else tagger
    shared = documents.sparkSession.sparkContext.broadcast(tagger)

    def run(batch):
        texts = [text or "" for text in batch.column("text").to_pylist()]
        base = [base_spans(text) for text in texts]
        added = model_spans(texts, shared.value)
        columns = {f"n_{kind}": [sum(x[0] == kind for x in spans) for spans in base] for kind in KINDS}
        columns["doc_id"] = batch.column("doc_id")
        columns["base_sha256"] = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
        columns["spans"] = [joined(merged(a, b)) for a, b in zip(base, added)]
        yield columns

    return map_batches(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The documents with every span of ``text`` replaced by its kind in angle brackets; a NULL
    text stays NULL. All columns stay; ``n_chars`` follows where there is one."""
    tagger = train(documents) if tagger is None else tagger
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    names, kinds = documents.columns, documents.schema
    place = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            old = batch.column(place).to_pylist()
            texts = [text or "" for text in old]
            new = [
                None if text is None else cut(text, merged(base_spans(text), more)) for text, more in zip(old, model_spans(texts, shared.value))
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            if count is not None:
                columns[count] = pa.array([None if text is None else len(text) for text in new], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(lean(run), kinds)


def cut(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced; of overlapping spans the earliest, then longest counts."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
            done = end
        elif end > done:
            done = end  # the rest of an overlapping span goes too
    return "".join(parts) + text[done:]


def query(spark, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))
