"""Media columns: baseline JPEG written and read in numpy.

Reading. Markers are parsed, entropy-coded segments are cut at the restart markers, and the
Huffman codes of all segments of a slice of rows are decoded in step, one symbol of every segment at a time
through a 16-bit look-up table. The DC coefficients give the luminance thumbnail (one pixel for each 8 x 8
block); dimensions and hashes of the thumbnail are kept.

Writing. A byte is a quantised coefficient of category 8: its eight extra bits are the byte itself, so 64 bytes
are one block and nothing is lost; a block is a restart interval. JPEG samples are not
exact through the cosine transform, hence the coefficient is the unit that is stored.

Defined results: a null text is stored as an empty one (one block of zeros); equal texts give equal
media; rows with a null doc_id or a repeated one are stored as any other; media that are null
or no baseline JPEG give null features; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import slices, table, text_bytes

SLICE_BYTES = 2 << 20
MOST_BLOCKS = 8191
#: The zigzag order of JPEG coefficients, by its rule: diagonals, every second one reversed.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


# ---- writing

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    """Width and height in blocks: the most nearly square exact grid, else the fewest blocks of padding."""
    for w in range(min(int(blocks**0.5), MOST_BLOCKS), 0, -1):
        if blocks % w == 0 and blocks // w <= MOST_BLOCKS:
            return w, blocks // w
    w = -(-blocks // MOST_BLOCKS)
    return w, -(-blocks // w)


def _header(w: int, h: int, payload: int) -> bytes:
    one_code = bytes([1] + [0] * 15 + [8])
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % payload),
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + one_code),
        _segment(0xC4, b"\x10" + one_code),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (a positive multiple of 64 bytes)."""
    out = []
    for p in payloads:
        n = len(p) // 64
        w, h = _grid(n)
        b = np.frombuffer(p, np.uint8)
        if w * h > n:
            b = np.concatenate([b, np.zeros((w * h - n) * 64, np.uint8)])
        b = b.reshape(-1, 8, 8).astype(np.uint16)
        bits = np.zeros((*b.shape[:2], 9), np.uint8)
        # eight codes of one zero bit and eight data bits are nine bytes
        for i in range(9):
            v = b[:, :, i] >> (i + 1) if i < 8 else 0
            if i:
                v = v | ((b[:, :, i - 1] & ((1 << i) - 1)) << (8 - i))
            bits[:, :, i] = v
        body = bits.reshape(-1, 72)
        marks = 0xD0 + (np.arange(len(body)) & 7)
        marks[-1] = 0xD9
        if (body == 0xFF).any():
            scan = b"".join(row.tobytes().replace(b"\xff", b"\xff\x00") + bytes([0xFF, m]) for row, m in zip(body, marks))
        else:
            scan = np.concatenate([body, np.full((len(body), 1), 0xFF, np.uint8), marks.astype(np.uint8)[:, None]], axis=1).tobytes()
        out.append(_header(w, h, len(p)) + scan)
    return out


# ---- reading

@dataclass
class Image:
    width: int = 0
    height: int = 0
    payload: int | None = None
    quant: dict = field(default_factory=dict)
    huff: dict = field(default_factory=dict)
    comps: list = field(default_factory=list)  # (id, h, v, quant)
    scan: list = field(default_factory=list)  # (component index, dc table, ac table)
    restart: int = 0
    data: bytes = b""
    coef: np.ndarray | None = None


_TABLES: dict[bytes, np.ndarray] = {}


def _lookup(spec: bytes) -> np.ndarray:
    """For each 16 next bits: code length * 256 + symbol; 0 where no code fits."""
    if spec not in _TABLES:
        if len(_TABLES) > 500:
            _TABLES.clear()
        out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
        for length in range(1, 17):
            for _ in range(spec[length - 1]):
                lo = code << (16 - length)
                out[lo : lo + (1 << (16 - length))] = length << 8 | spec[at]
                code, at = code + 1, at + 1
            code <<= 1
        _TABLES[spec] = out
    return _TABLES[spec]


def parse(data: bytes | None) -> Image | None:
    """Markers of a baseline JPEG of one scan; None for anything else."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    im, at = Image(), 2
    try:
        while True:
            if data[at] != 0xFF:
                return None
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE and body.startswith(b"payload="):
                im.payload = int(body[8:])
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    im.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker in (0xC0, 0xC1):
                _, im.height, im.width, n = struct.unpack_from(">BHHB", body)
                im.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return None
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    im.huff[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                (im.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                ids = [c[0] for c in im.comps]
                im.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = data.rfind(b"\xff\xd9")
                im.data = data[at : end if end >= at else len(data)]
                ok = im.width and im.height and im.comps and len(im.scan) == len(im.comps) and all(c[3] in im.quant for c in im.comps)
                return im if ok and all(dc in im.huff and 16 + ac in im.huff for _, dc, ac in im.scan) else None
    except (IndexError, ValueError, struct.error):
        return None


def _layout(im: Image) -> tuple[list[int], int, int]:
    """Components of an MCU's blocks, and MCUs across and down."""
    if len(im.scan) == 1:
        return [im.scan[0][0]], -(-im.width // 8), -(-im.height // 8)
    pattern = [c for c, _, _ in im.scan for _ in range(im.comps[c][1] * im.comps[c][2])]
    hm, vm = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    return pattern, -(-im.width // (8 * hm)), -(-im.height // (8 * vm))


def decode(images: list[Image | None]) -> None:
    """Fill ``coef`` (blocks in coded order x 64, zigzag) of the images; None where the data end early."""
    live = [im for im in images if im is not None]
    if not live:
        return
    specs: dict[bytes, int] = {}
    scans, starts, lane_im, lane_mcus, first_block, dcs, acs, patterns, total = [], [], [], [], [], [], [], [], []
    base = blocks = 0
    for k, im in enumerate(live):
        pattern, across, down = _layout(im)
        raw = np.frombuffer(im.data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.empty(0, np.int64)
        after = raw[ff + 1]
        cut = ff[(after >= 0xD0) & (after <= 0xD7)]
        # without stuffed zeros and markers
        gone = np.concatenate([ff[after == 0] + 1, cut, cut + 1])
        keep = np.ones(len(raw), bool)
        keep[gone] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        seg = np.concatenate([[0], before[cut]]).astype(np.int64)
        mcus = across * down
        per = im.restart or mcus
        want = -(-mcus // per)
        seg = seg[:want]
        n = np.full(len(seg), per)
        if len(seg) == want:
            n[-1] = mcus - per * (want - 1)
        scans += [raw[keep], np.zeros(8, np.uint8)]
        starts.append(base + seg)
        base += int(before[-1]) + 8
        lane_im.append(np.full(len(seg), k))
        lane_mcus.append(n)
        first_block.append(blocks + np.arange(len(seg)) * per * len(pattern))
        total.append((blocks, mcus * len(pattern), len(seg) == want))
        blocks += mcus * len(pattern)
        tables = {c: (specs.setdefault(im.huff[dc], len(specs)), specs.setdefault(im.huff[16 + ac], len(specs))) for c, dc, ac in im.scan}
        patterns.append(pattern)
        dcs.append([tables[c][0] for c in pattern])
        acs.append([tables[c][1] for c in pattern])
    lut = np.concatenate([_lookup(s) for s in specs])
    wide = max(map(len, patterns))
    grid = lambda rows: np.array([r + [0] * (wide - len(r)) for r in rows], np.int64)
    pat, dcs, acs, plen = grid(patterns), grid(dcs), grid(acs), np.array([len(p) for p in patterns])
    data = np.concatenate(scans)
    win = np.zeros(len(data), np.uint32)
    for j in range(4):
        win[: len(data) - j] |= data[j:].astype(np.uint32) << np.uint32(24 - 8 * j)
    coef = np.zeros((blocks, 64), np.int16)
    pos = np.concatenate(starts).astype(np.int64) * 8
    of, block = np.concatenate(lane_im), np.concatenate(first_block)
    left = np.concatenate(lane_mcus) * plen[of]
    pred = np.zeros((len(pos), int(pat.max()) + 1), np.int64)
    turn = np.zeros(len(pos), np.int64)
    bad = np.zeros(len(live), bool)
    end = len(data) * 8 - 32

    def peek(p: np.ndarray) -> np.ndarray:
        return (win[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def symbol(lanes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next symbols, and the values of their extra bits."""
        p = pos[lanes]
        code = lut[(which << 16) + peek(p)]
        sym = (code & 0xFF).astype(np.int64)
        p += code >> 8
        size = sym & 15
        bits = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int64)
        value = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)
        pos[lanes] = np.minimum(p + size, end)
        bad[of[lanes[code == 0]]] = True
        return sym, value

    lanes = np.flatnonzero(left > 0)
    while len(lanes):
        o = of[lanes]
        t = turn[lanes] % plen[o]
        c = pat[o, t]
        _, diff = symbol(lanes, dcs[o, t])
        pred[lanes, c] += diff
        coef[block[lanes], 0] = pred[lanes, c]
        ac = acs[o, t]
        k = np.ones(len(lanes), np.int64)
        on = np.arange(len(lanes))
        while len(on):
            sym, value = symbol(lanes[on], ac[on])
            run, size = sym >> 4, sym & 15
            k[on] += run
            put = (size > 0) & (k[on] < 64)
            if put.all():
                coef[block[lanes[on]], k[on]] = value
                k[on] += 1
            else:
                coef[block[lanes[on[put]]], k[on[put]]] = value[put]
                k[on] += (size > 0) | (run == 15)
                k[on[(size == 0) & (run < 15)]] = 64
            on = on[k[on] < 64]
        turn[lanes] += 1
        block[lanes] += 1
        lanes = lanes[turn[lanes] < left[lanes]]
    for k, (im, (at, n, whole)) in enumerate(zip(live, total)):
        im.coef = coef[at : at + n] if whole and not bad[k] else None


def payload_of(im: Image) -> bytes:
    """The bytes that ``encode`` stored in the coefficients."""
    v = im.coef.ravel()[: im.payload]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def thumbnail(im: Image) -> np.ndarray:
    """Luminance from the DC coefficients of the first component: one pixel for a block."""
    pattern, across, down = _layout(im)
    dc = im.coef[:, 0].astype(np.int64).reshape(down, across, len(pattern))
    mine = [i for i, c in enumerate(pattern) if c == 0]
    h = im.comps[0][1] if len(im.scan) > 1 else 1
    rows = dc[:, :, mine].reshape(down, across, -1, h).transpose(0, 2, 1, 3).reshape(down * (len(mine) // h), across * h)
    pixels = np.clip(np.round(rows * int(im.quant[im.comps[0][3]][0]) / 8) + 128, 0, 255).astype(np.uint8)
    return pixels[: -(-im.height // 8), : -(-im.width // 8)]


def features(im: Image) -> dict:
    """Dimensions, SHA-256 of the thumbnail, and its average hash over 8 x 8 nearest pixels."""
    t = thumbnail(im)
    small = t[np.arange(8) * t.shape[0] // 8][:, np.arange(8) * t.shape[1] // 8]
    average = np.packbits(small > small.mean()).tobytes().hex()
    return {"width": im.width, "height": im.height, "thumb_sha256": hashlib.sha256(t.tobytes()).hexdigest(), "thumb_ahash": average}


# ---- Spark

def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = text_bytes(part.column("text"))
            media = encode([padded(t) for t in texts])
            at = part.schema.get_field_index("text")
            rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [n for n, _ in rest] + ["n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes and a binary column ``media`` in place of ``text``."""
    docs = docs.drop("n_bytes", "media")
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_stored, ", ".join([*rest, "n_bytes long", "media binary"]))


FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "width": pa.int32(), "height": pa.int32(), "thumb_sha256": pa.string(), "thumb_ahash": pa.string(), "feature": pa.string()}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media", SLICE_BYTES):
            media = part.column("media").to_pylist()
            images = [parse(m) for m in media]
            decode(images)
            rows = []
            for m, im in zip(media, images):
                row = {}
                if m is not None:
                    row |= {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
                if im is not None and im.coef is not None:
                    row |= features(im)
                    row["feature"] = f"{im.width}x{im.height}:{row['thumb_sha256'][:16]}:{row['thumb_ahash']}"
                    if im.payload is not None:
                        p = payload_of(im)
                        row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:])}
                rows.append(row)
            made = [pa.array([r.get(k) for r in rows], t) for k, t in FEATURES.items()]
            rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if n != "media" and n not in FEATURES]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + made, [n for n, _ in rest] + list(FEATURES))


def media_features(media: DataFrame) -> DataFrame:
    """Rows with the features of their column ``media`` in its place."""
    kinds = {"payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "width": "int", "height": "int"}
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media" and f.name not in FEATURES]
    return media.mapInArrow(_features, ", ".join([*rest, *(f"{k} {kinds.get(k, 'string')}" for k in FEATURES)]))


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
