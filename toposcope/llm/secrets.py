"""Secret scanning with a random forest that removes false positives.

A scan finds candidates: long runs of token characters that mix digits and letters, cut at assignment signs;
and every value after an assignment sign or a secret word, of any length and alphabet (to the closing quote, or
to the next white space where there is none). Each becomes a row of
numbers: its length, how often the kind of character changes, how much of it words of a dictionary cover,
whether it looks like a path, and which words stand beside it. A random forest trained on labelled findings
turns these into a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

LEAST = 16
SAMPLE_ROWS = 4000  # texts whose findings may be used for training
NEIGHBOURS = (
    "token key secret password passwd pwd api apikey auth bearer access credential private "
    "passphrase pass pin credentials commit sha sha1 sha256 md5 hash checksum digest revision version uuid id path file url http https"
).split()
FEATURES = ["length", "entropy", "digits", "uppers", "changes", "unlikely_pairs", "hex", "dictionary", "path", "quoted", "assigned", "repeated", "named", "signs", "words", *(f"near_{w}" for w in NEIGHBOURS)]
# Everyday words; a secret rarely contains them.
DICTIONARY = (
    "about after again also and are because been before best between both but can come could day did each even example file find first for from get give good great have "
    "here high home house into just know large last life like line little long made make man many may more most much must name never new not now number off old one only other "
    "our out over own page part people place same say see set she show sample small some such take test than that the their them then there these they thing think this time two "
    "under use user very was water way well were what when where which while who will with word work world would year you your image index data http www com org html config "
    "placeholder changeme dummy default value string"
).split()
_CANDIDATE = re.compile(rb"[A-Za-z0-9_\-+/=.]{%d,}" % LEAST)
_ASSIGN = re.compile(rb"[=:]+>?")
_NAMES = rb"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_ -]?key|(?:access|private|secret)[_ -]?key|bearer|credentials?|auth)"
_NAMED = re.compile(rb"(?i:%s)[\"']?[ \t]+(?:(?:is|was)[ \t]+)?(?![=:])" % _NAMES)
_NAMED_BEFORE = re.compile(rb"(?i:%s)[\"'\])]*[ \t]*(?:[=:]+>?|[ \t](?:is|was)|[ \t])[ \t\"'`]*$" % _NAMES)
# An unquoted value ends at white space, at a sign that closes a structure or a field (`,"` `}` `]` `;`), or where
# `&name=` / `,name:` begins the next field.
_VALUE = re.compile(rb"[ \t]*(?:\"((?:[^\"\\\n]|\\[^\n])+)\"|'((?:[^'\\\n]|\\[^\n])+)'|`([^`\n]+)`|((?:(?![&,;]\w+[=:]|,[\"']|[}\];])[^\x09-\x0D\x20])+))")
_WORD = re.compile(rb"[a-z0-9]+")
_PAIRS = {a + b for w in DICTIONARY for a, b in zip(w, w[1:], strict=False)}
_DICTIONARY_AT = re.compile("(?=(%s))" % "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
_NEIGHBOURS = [w.encode() for w in NEIGHBOURS]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(candidate: str, before: bytes, after: bytes) -> list[float]:
    """The numbers of one candidate; ``before`` and ``after`` are the bytes beside it (some 40 are enough)."""
    n = len(candidate)
    low = candidate.lower()
    counts = list(Counter(candidate).values())
    kinds = [_kind(c) for c in candidate]
    letters = [(a, b) for a, b in zip(low, low[1:], strict=False) if a.isalpha() and b.isalpha()]
    seen = bytearray(n)
    for m in _DICTIONARY_AT.finditer(low):  # at every place the longest dictionary word, which covers the shorter ones
        seen[m.start() : m.start() + len(m.group(1))] = b"\x01" * len(m.group(1))
    near = set(_WORD.findall(before.lower())[-3:]) | set(_WORD.findall(after.lower())[:2])
    tail = before.rstrip()
    return [
        float(n), -sum(k / n * math.log2(k / n) for k in counts), kinds.count(0) / n, kinds.count(2) / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(a + b not in _PAIRS for a, b in letters) / max(1, len(letters)), float(all(c in "0123456789abcdef" for c in low)), seen.count(1) / n,
        (candidate.count("/") + candidate.count(".")) / n, float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")), float(tail.rstrip(b"\"' ")[-1:] in (b"=", b":")),
        max(counts) / n, float(_NAMED_BEFORE.search(before) is not None), kinds.count(3) / n, float(len(candidate.split())), *(float(w in near) for w in _NEIGHBOURS),
    ]


def _runs(found: W.Words) -> Iterator[tuple[int, int]]:
    """Spans of long runs that mix digits and letters; an assignment sign inside a run parts it."""
    digit = np.r_[0, np.cumsum((found.data >= 48) & (found.data <= 57))]
    for k in np.flatnonzero((found.end - found.start >= LEAST) & (digit[found.end] > digit[found.start])):
        for m in _CANDIDATE.finditer(found.data[found.start[k] : found.end[k]].tobytes()):
            # Padding may end a secret, the rest are word signs around it.
            for part in re.finditer(rb"(?:[^=]|=+$)+", m.group()):
                body = part.group().strip(b"=.-/")
                if len(body) >= LEAST and re.search(rb"\d", body) and re.search(rb"[A-Za-z]", body):
                    a = int(found.start[k]) + m.start() + part.start() + part.group().index(body)
                    yield a, a + len(body)


def _values(data: bytes, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of what follows an assignment sign after a name, or a secret word, in the same row and line.

    Signs and words are taken from left to right, and one inside a value already taken starts none: values never
    nest, so their lengths add up to the text's at most (``a=a=a=…`` is one value, not one per sign).
    """
    marks = sorted((m.start(), m.end(), pattern is _ASSIGN) for pattern in (_ASSIGN, _NAMED) for m in pattern.finditer(data))
    taken = 0
    for start, end, sign in marks:
        if start < taken:
            continue
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        low, high = int(offsets[row]), int(offsets[row + 1])
        if end >= high or (sign and not re.search(rb"[\w\"'`)\]\x80-\xff]$", data[max(low, start - 9) : start].rstrip(b" \t"))):
            continue
        v = _VALUE.match(data, end, high)
        if v is None:
            continue
        a, b = v.span(v.lastindex)
        if v.lastindex == 4:
            b = a + len(data[a:b].rstrip(b",;.)]}>\"'`"))
        if b > a:
            taken = b
            yield a, b


def _scan(batches: Iterator[pa.RecordBatch], masked: bool) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        found = W.find_words(chunk.column("text"))
        ids, keys = chunk.column("doc_id").to_pylist(), chunk.column("text_crc32").to_pylist()
        data, rows = found.data.tobytes(), []
        for a, b in sorted({*_runs(found), *_values(data, found.offsets)}):
            row = int(np.searchsorted(found.offsets, a, side="right")) - 1
            low, high = int(found.offsets[row]), int(found.offsets[row + 1])
            body = data[a:b].decode("utf-8", "replace")
            rows.append(
                {
                    "doc_id": ids[row], "text_crc32": keys[row], "byte_start": a - low, "byte_end": b - low, "preview": body[: min(4, len(body) // 4)] + "..." if masked else body,
                    "secret_sha256": hashlib.sha256(data[a:b]).hexdigest(), "features": features(body, data[max(low, a - 48) : a], data[b : min(high, b + 32)]),
                }
            )
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("preview", pa.string()), ("secret_sha256", pa.string()), ("features", pa.list_(pa.float64()))])
_DDL = "doc_id long, text_crc32 long, byte_start long, byte_end long, preview string, secret_sha256 string, features array<double>"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))


def scan(docs: DataFrame, masked: bool = True) -> DataFrame:
    """Candidates of all texts with their features: one row each, in whole texts.

    ``preview`` shows four characters, or a quarter of short ones (all, if not ``masked``). Spans may overlap: a
    quoted value and a run inside it are both candidates. Null and empty texts have none; repeated rows
    and null ids keep theirs.
    """
    return _texts(docs).mapInArrow(partial(_scan, masked=masked), _DDL)


_MADE_DDL = "label int, features array<double>"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled findings from texts: see ``labelled_findings``."""
    for batch in W.text_chunks(batches):
        out = []
        for key, text in zip(batch.column("text_crc32").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = [w.decode("utf-8", "ignore") for w in text.split()[:2000]]
            own = [w for w in own if re.fullmatch("[A-Za-z]{3,}", w)]
            if len(own) < 12:
                continue
            draw = np.random.default_rng(key)
            pick = lambda: own[int(draw.integers(len(own)))].lower()
            digest = hashlib.sha256(text).digest()
            body = {
                "hex": digest.hex()[: int(draw.choice([32, 40, 64]))],
                "mixed": "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), int(draw.integers(20, 44)))),
                "url_safe": "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"), int(draw.integers(24, 64)))),
            }
            pair = lambda name, v: (f'{pick()} {name} = "'.encode(), v, f'" {pick()}'.encode())
            for v in body.values():
                name = str(draw.choice(["token", "api_key", "secret", "password", "access key", "auth token", "private key"]))
                out.append((1, *pair(name, v)))
                out.append((1, *pair(name.upper(), v.upper() if v == body["hex"] else v)))
                out.append((1, f"{pick()} {name}: ".encode(), v, b" " + pick().encode()))
            h = digest.hex()
            uuid = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
            year = int(draw.integers(1990, 2030))
            for kind, v in (("commit", h[:40]), ("sha256", h), ("md5", h[:32]), ("checksum", h[:40]), ("uuid", uuid), ("id", uuid), ("revision", h[:40])):
                out.append((0, f"{pick()} {kind} ".encode(), v, f" {pick()}".encode()))
                out.append((0, f"{pick()} {kind}: ".encode(), v, f" {pick()}".encode()))
            for v in (f"{pick()}/{pick()}/{year}/{pick()}.html", f"{pick()}_{pick()}_{pick()}_{year}", f"{pick()}{pick()}{pick()}{year}", f"{pick()}-{pick()}-{pick()}-{year}", f"mail{year}.{pick()}.example.com", f"{pick()}.{pick()}.v{year}", "-".join([pick(), str(year), pick(), "example", "key1"])):
                if len(v) >= LEAST:
                    out.append((0, f"{pick()} {pick()} ".encode(), v, f" {pick()}".encode()))
                    out.append((0, f"{pick()} path ".encode(), v, f" {pick()}".encode()))
            # Short ones, other alphabets and other forms of assignment.
            letters, digits = list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"), list("0123456789")
            chosen = lambda alphabet, low, high: "".join(draw.choice(alphabet, int(draw.integers(low, high))))
            short = [
                f"{pick()}{draw.integers(1, 100)}{pick()}", chosen(letters + digits, 8, 16), chosen(letters + digits + list("!@#$%^&*?"), 8, 24), chosen(letters, 8, 24),
                f"{pick()}{pick()}{pick()}", chosen(digits, 6, 17), body["mixed"], body["hex"], body["url_safe"],
            ]
            names = ["password", "passwd", "db_password", "api_key", "apikey", "secret", "client_secret", "auth_token", "token", "PASSWORD", "API_KEY", "passphrase", "pwd", "userPassword"]
            plain = ["title", "count", "name", "size", "lang", "note", "color", "year", "label", "class", "href", "width", pick(), pick(), pick()]
            other = [pick(), f"{pick()} {pick()} {pick()}", str(int(draw.integers(0, 10 ** int(draw.integers(1, 9))))), str(year), f"{pick()}-{pick()}", f"//{pick()}.com/{pick()}", pick().capitalize(), f"{pick()}.{pick()}()", *short[:7:2]]
            forms = [('{w} {n} = "', '" {w}'), ("{w} {n}: ", " {w}"), ("{w} {n}=", " {w}"), ('{{"{n}": "', '"}}'), ("{w}?{n}=", "&{w}=1"), ("{n} = '", "'\n"), ("{w} {w}\n{n}:", "\n")]
            for label, keys, values in ((1, names, [*short, f"{pick()} {pick()} {pick()} {pick()}"]), (0, plain, other)):
                for v in values:
                    for k in draw.choice(len(forms), 3, replace=False):
                        if " " in v and k in (1, 2, 4, 6):
                            continue
                        pre, post = (f.format(w=pick(), n=str(draw.choice(keys))) for f in forms[int(k)])
                        out.append((label, pre.encode(), v, post.encode()))
            for v in [short[0], short[1], short[2], body["mixed"]]:
                out.append((1, f"{pick()} {draw.choice(names)} is ".encode(), v, f" {pick()}".encode()))
                out.append((1, f"{pick()} {draw.choice(names)} ".encode(), v, f" {pick()}".encode()))
            for v in (pick(), pick(), "is", "of", "and", "required", pick()):
                out.append((0, f"{pick()} {draw.choice(names)} ".encode(), v, f" {pick()}".encode()))
                out.append((0, f"{pick()} {draw.choice(names)} is ".encode(), v, f" {pick()}".encode()))
            for v in ("null", "None", "true", "false", "string", "<value>", "${PASSWORD}"):
                out.append((0, f"{pick()} {draw.choice(names)} = ".encode(), v, b"\n"))
                out.append((0, f"{pick()} {draw.choice(names)}: ".encode(), v, f" {pick()}".encode()))
            out.append((0, f'{pick()} token = "'.encode(), f"your-{pick()}-token-here-1", b'"'))
            out.append((0, f'{pick()} password = "'.encode(), "example0000000000" + "x" * 8, b'"'))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([features(o[2], o[1], o[3]) for o in out], pa.list_(pa.float64()))], names=["label", "features"]
        )


def labelled_findings(docs: DataFrame, sample_rows: int = 400) -> DataFrame:
    """``(label, features)`` where no reviewed findings are at hand.

    For a bounded sample of texts (by hash of the text), findings are set among the text's own words: keys and
    tokens in assignments, passwords and passphrases of any kind of sign as true ones; commit ids, digests, uuids,
    paths, identifiers, addresses, placeholders, plain values and prose after a secret word as false ones. The text's checksum seeds the draw. Twenty texts of dictionary words join the
    sample, so that there is something to learn from where no text has a dozen plain words.
    """
    plain = docs.sparkSession.range(20).select(F.col("id").alias("doc_id"), F.lit(" ".join(DICTIONARY)).alias("text"), F.col("id").alias("text_crc32"))
    sample = _texts(docs).where("text is not null").orderBy(F.xxhash64("text_crc32", "doc_id"), "doc_id").limit(sample_rows)
    return sample.unionByName(plain).mapInArrow(_labelled, _MADE_DDL)


def train(labelled: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7, most_rows: int = 200_000) -> RandomForestClassificationModel:
    """Fit the forest on at most ``most_rows`` labelled rows (``label``, ``features``), in an order that hashes fix."""
    rows = labelled.where("label is not null and features is not null").orderBy(F.xxhash64("label", "features")).limit(most_rows).coalesce(1)
    vectors = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)


def score(findings: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (the forest's chance of a true secret) and ``is_secret`` to scanned candidates."""
    scored = model.transform(findings.withColumn("features", array_to_vector("features")))
    score_ = F.round(vector_to_array("probability")[1], 6)
    return scored.withColumn("score", score_).withColumn("is_secret", score_ >= threshold).drop("rawPrediction", "probability", "prediction", "features")


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, text_crc32, byte_start, byte_end, preview, secret_sha256, score, is_secret)`` of all candidates."""
    return score(scan(docs), model or train(labelled_findings(docs)), threshold)


def _redact(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, spans in zip(batch.column(at), batch.column("secret_spans").to_pylist(), strict=True):
            if not spans:
                out.append(text.as_py())
                continue
            data = text.as_py().encode()
            whole: list[list[int]] = []
            for a, b in sorted({(x["byte_start"], x["byte_end"]) for x in spans}):
                if whole and a < whole[-1][1]:
                    whole[-1][1] = max(b, whole[-1][1])
                else:
                    whole.append([a, b])
            for a, b in reversed(whole):
                data = data[:a] + mark + data[b:]
            out.append(data.decode())
        yield batch.set_column(at, "text", pa.array(out, pa.string())).drop_columns(["secret_spans"])


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with every ``is_secret`` finding's bytes replaced by ``mark``."""
    found = findings.where("is_secret").groupBy(F.col("doc_id").alias("found_id"), F.col("text_crc32").alias("found_crc")).agg(F.collect_set(F.struct("byte_start", "byte_end")).alias("secret_spans"))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(found, (docs["doc_id"].cast("long").eqNullSafe(F.col("found_id"))) & (crc == F.col("found_crc")), "left").select(*docs.columns, "secret_spans")
    return joined.mapInArrow(partial(_redact, mark=mark.encode()), docs.schema)
