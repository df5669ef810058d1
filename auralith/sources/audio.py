"""Audio files as bytes to signals and back: WAV and AIFF natively, others where a decoder is registered."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from auralith.functions.dsp import round_half_up


class CodecError(ValueError):
    """Bytes that cannot be decoded, or a signal that cannot be encoded."""


@dataclass
class Signal:
    rate: int
    channels: int
    depth: int
    data: np.ndarray  # interleaved, -1 to 1

    @property
    def frames(self) -> int:
        return len(self.data) // self.channels if self.channels > 0 else 0

    @property
    def seconds(self) -> float:
        return self.frames / self.rate if self.rate > 0 else 0.0

    def check(self) -> None:
        if self.rate <= 0 or self.channels <= 0 or not len(self.data) or len(self.data) % self.channels or np.abs(self.data).max() > 1:
            raise CodecError("signal is not valid")


def _integers(raw: bytes, depth: int, little: bool, offset_bytes: bool) -> np.ndarray:
    """Whole samples of 8, 16, 24 or 32 bits; offset_bytes: 8-bit samples count from 128."""
    if depth == 8:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128 if offset_bytes else np.frombuffer(raw, np.int8).astype(np.int64)
    if depth in (16, 32):
        kind = f"{'<' if little else '>'}i{depth // 8}"
        return np.frombuffer(raw[: len(raw) // (depth // 8) * (depth // 8)], kind).astype(np.int64)
    if depth == 24:
        parts = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        low, mid, high = (parts[:, k] for k in ((0, 1, 2) if little else (2, 1, 0)))
        return ((low | mid << 8 | high << 16) ^ 0x800000) - 0x800000
    raise CodecError(f"unsupported depth of {depth} bits")


def _scaled(values: np.ndarray, depth: int) -> np.ndarray:
    return np.clip(values / 2.0 ** (depth - 1), -1, 1)


def _chunks(body: bytes, little: bool):
    at = 12
    while at + 8 <= len(body):
        name, size = body[at : at + 4], struct.unpack("<I" if little else ">I", body[at + 4 : at + 8])[0]
        yield name, body[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def read_wav(body: bytes) -> Signal:
    if body[:4] != b"RIFF" or body[8:12] != b"WAVE":
        raise CodecError("not a WAV file")
    form = None
    for name, data in _chunks(body, True):
        if name == b"fmt ":
            if len(data) < 16:
                raise CodecError("WAV format is cut off")
            kind, channels, rate, _, _, depth = struct.unpack("<HHIIHH", data[:16])
            if kind == 0xFFFE and len(data) >= 26:
                kind = struct.unpack("<H", data[24:26])[0]
            form = kind, channels, rate, depth
        elif name == b"data" and form:
            kind, channels, rate, depth = form
            if kind != 1 or not channels:
                raise CodecError("only integer PCM is supported")
            return Signal(rate, channels, depth, _scaled(_integers(data, depth, True, True), depth))
    raise CodecError("WAV file without samples")


def _extended(raw: bytes) -> float:
    """An 80-bit big-endian float."""
    exponent, mantissa = struct.unpack(">HQ", raw)
    return (-1 if exponent >> 15 else 1) * mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def _to_extended(value: int) -> bytes:
    bits = value.bit_length()
    return struct.pack(">HQ", 16383 + bits - 1, value << (64 - bits))


def read_aiff(body: bytes) -> Signal:
    if body[:4] != b"FORM" or body[8:12] not in (b"AIFF", b"AIFC"):
        raise CodecError("not an AIFF file")
    common = sound = None
    little = False
    for name, data in _chunks(body, False):
        if name == b"COMM":
            channels, _, depth = struct.unpack(">hIh", data[:8])
            common = channels, depth, int(_extended(data[8:18]))
            if body[8:12] == b"AIFC":
                if data[18:22] not in (b"NONE", b"sowt"):
                    raise CodecError("compressed AIFF is not supported")
                little = data[18:22] == b"sowt"
        elif name == b"SSND":
            sound = data[8 + struct.unpack(">I", data[:4])[0] :]
    if common is None or sound is None or common[0] <= 0:
        raise CodecError("AIFF file without samples")
    channels, depth, rate = common
    depth = -(-depth // 8) * 8
    return Signal(rate, channels, depth, _scaled(_integers(sound, depth, little, False), depth))


def _to_integers(signal: Signal) -> np.ndarray:
    top = 2.0 ** (signal.depth - 1)
    return np.clip(round_half_up(signal.data * (top - 1)), -top, top - 1).astype(np.int64)


def _bytes(values: np.ndarray, depth: int, little: bool, offset_bytes: bool) -> bytes:
    if depth == 8:
        return (values + 128).astype(np.uint8).tobytes() if offset_bytes else values.astype(np.int8).tobytes()
    if depth == 24:
        parts = np.stack([values >> s & 0xFF for s in ((0, 8, 16) if little else (16, 8, 0))], 1)
        return parts.astype(np.uint8).tobytes()
    return values.astype(f"{'<' if little else '>'}i{depth // 8}").tobytes()


def _depth(signal: Signal) -> int:
    signal.check()
    depth = signal.depth or 16
    if depth not in (8, 16, 24, 32):
        raise CodecError(f"unsupported depth of {depth} bits")
    return depth


def write_wav(signal: Signal) -> bytes:
    depth = _depth(signal)
    data = _bytes(_to_integers(signal), depth, True, True)
    frame = signal.channels * depth // 8
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, signal.channels, signal.rate, signal.rate * frame, frame, depth, b"data", len(data))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(data) + len(data) % 2) + b"WAVE" + head + data + b"\0" * (len(data) % 2)


def write_aiff(signal: Signal) -> bytes:
    depth = _depth(signal)
    data = _bytes(_to_integers(signal), depth, False, False)
    common = struct.pack(">4sIhIh", b"COMM", 18, signal.channels, signal.frames, depth) + _to_extended(signal.rate)
    sound = struct.pack(">4sIII", b"SSND", 8 + len(data), 0, 0) + data + b"\0" * (len(data) % 2)
    return b"FORM" + struct.pack(">I", 4 + len(common) + len(sound)) + b"AIFF" + common + sound


def _by_soundfile(body: bytes) -> Signal:
    try:
        import soundfile  # optional
    except ImportError as e:
        raise CodecError("no decoder registered for this format") from e
    import io

    data, rate = soundfile.read(io.BytesIO(body), dtype="float64", always_2d=True)
    return Signal(rate, data.shape[1], 16, data.ravel())


DECODERS: dict[str, Callable[[bytes], Signal]] = {"wav": read_wav, "aiff": read_aiff, "flac": _by_soundfile, "mp3": _by_soundfile, "ogg": _by_soundfile}
ENCODERS: dict[str, Callable[[Signal], bytes]] = {"wav": write_wav, "aiff": write_aiff}


def formats() -> tuple[list[str], list[str]]:
    """Names of the formats that can be read, and written."""
    return sorted(DECODERS), sorted(ENCODERS)


def decode(body: bytes, form: str) -> Signal:
    if form not in DECODERS:
        raise CodecError(f"no decoder registered for {form!r}")
    try:
        return DECODERS[form](body)
    except struct.error as e:
        raise CodecError(f"{form} file is cut off") from e


def encode(signal: Signal, form: str) -> bytes:
    if form not in ENCODERS:
        raise CodecError(f"no encoder registered for {form!r}")
    return ENCODERS[form](signal)


# fixed values: ID3 frames and RIFF INFO chunks by the names of the embedded fields
ID3_FRAMES = {"TIT2": "title", "TALB": "album", "TPE1": "artist", "TPE2": "album_artist", "TCOM": "composer", "TCON": "genre", "COMM": "comment", "USLT": "lyrics", "TYER": "year", "TDRC": "year", "TRCK": "track", "TPOS": "disc"}
ID3_OLD = {"TT2": "TIT2", "TAL": "TALB", "TP1": "TPE1", "TP2": "TPE2", "TCM": "TCOM", "TCO": "TCON", "COM": "COMM", "ULT": "USLT", "TYE": "TYER", "TRK": "TRCK", "TPA": "TPOS", "PIC": "APIC"}
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _id3_text(frame: str, data: bytes) -> str:
    kind, rest = ENCODINGS.get(data[0], "latin-1"), data[1:]
    if frame in ("COMM", "USLT"):  # language, then a description that ends like the text
        rest = rest[3:]
        wide = data[0] in (1, 2)
        end = next((k for k in range(0, len(rest), 1 + wide) if not any(rest[k : k + 1 + wide])), len(rest))
        rest = rest[end + 1 + wide :]
    return rest.decode(kind, "replace").split("\0")[0].strip()


# fixed values: Vorbis comment keys and MP4 atoms by the names of the embedded fields
VORBIS_KEYS = {"TITLE": "title", "ALBUM": "album", "ARTIST": "artist", "ALBUMARTIST": "album_artist", "COMPOSER": "composer", "GENRE": "genre", "COMMENT": "comment", "DESCRIPTION": "comment", "LYRICS": "lyrics", "DATE": "year", "YEAR": "year", "TRACKNUMBER": "track", "TRACKTOTAL": "track_total", "TOTALTRACKS": "track_total", "DISCNUMBER": "disc", "DISCTOTAL": "disc_total", "TOTALDISCS": "disc_total"}
MP4_ATOMS = {b"\xa9nam": "title", b"\xa9alb": "album", b"\xa9ART": "artist", b"aART": "album_artist", b"\xa9wrt": "composer", b"\xa9gen": "genre", b"\xa9cmt": "comment", b"\xa9lyr": "lyrics", b"\xa9day": "year"}


def _put(fields: dict[str, str], field: str, text: str) -> None:
    """Adds a field that is not blank; numbers only if positive, a year from its first four digits, "3/12" as both."""
    text = text.strip()
    if field in ("track", "disc"):
        number, _, total = text.partition("/")
        fields |= {n: str(int(v)) for n, v in ((field, number), (f"{field}_total", total)) if v.strip().isdigit() and int(v) > 0}
    elif field.endswith("_total"):
        if text.isdigit() and int(text) > 0:
            fields[field] = str(int(text))
    elif field == "year":
        if text[:4].isdigit():
            fields[field] = str(int(text[:4]))
    elif text:
        fields[field] = text


def _vorbis(data: bytes) -> tuple[dict[str, str], bool]:
    """Of a comment block: lengths are little-endian; the first of repeated keys counts."""
    fields: dict[str, str] = {}
    taken, picture = set(), False
    at = 4 + int.from_bytes(data[:4], "little")
    count = int.from_bytes(data[at : at + 4], "little")
    at += 4
    for _ in range(count):
        if at + 4 > len(data):
            break
        size = int.from_bytes(data[at : at + 4], "little")
        key, _, text = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        field = VORBIS_KEYS.get(key.upper())
        picture |= key.upper() == "METADATA_BLOCK_PICTURE"
        if field and key.upper() not in taken and (field != "comment" or "comment" not in fields):
            taken.add(key.upper())
            _put(fields, field, text)
    return fields, picture


def _flac(body: bytes) -> tuple[dict[str, str], bool]:
    fields, picture, at, last = {}, False, 4, False
    while not last and at + 4 <= len(body):
        kind, size = body[at], int.from_bytes(body[at + 1 : at + 4], "big")
        last = bool(kind & 0x80)
        if kind & 0x7F == 4:
            fields, other = _vorbis(body[at + 4 : at + 4 + size])
            picture |= other
        picture |= kind & 0x7F == 6
        at += 4 + size
    return fields, picture


def _ogg(body: bytes) -> tuple[dict[str, str], bool]:
    """The second packet of the stream; packets run on over pages as long as their segments are full."""
    at, packet, packets = 0, b"", 0
    while at + 27 <= len(body) and body[at : at + 4] == b"OggS":
        sizes = body[at + 27 : at + 27 + body[at + 26]]
        at += 27 + len(sizes)
        for size in sizes:
            packet += body[at : at + size]
            at += size
            if size < 255:
                packets += 1
                if packets == 2:
                    head = 7 if packet[:7] == b"\x03vorbis" else 8 if packet[:8] == b"OpusTags" else 0
                    return _vorbis(packet[head:]) if head else ({}, False)
                packet = b""
    return {}, False


def _atoms(data: bytes):
    at = 0
    while at + 8 <= len(data):
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or len(data) - at
        if size < head:
            return
        yield name, data[at + head : at + size]
        at += size


def _mp4(body: bytes) -> tuple[dict[str, str], bool]:
    """moov / udta / meta / ilst: each atom there holds a data atom, whose value follows a type and a locale."""
    data = body
    for step in (b"moov", b"udta", b"meta", b"ilst"):
        data = next((x for name, x in _atoms(data) if name == step), b"")
        if step == b"meta":
            data = data[4:]
    fields: dict[str, str] = {}
    picture = False
    for name, own in _atoms(data):
        value = next((x[8:] for inner, x in _atoms(own) if inner == b"data"), b"")
        if name in MP4_ATOMS:
            _put(fields, MP4_ATOMS[name], value.decode("utf-8", "replace"))
        elif name in (b"trkn", b"disk") and len(value) >= 6:
            _put(fields, "track" if name == b"trkn" else "disc", f"{int.from_bytes(value[2:4], 'big')}/{int.from_bytes(value[4:6], 'big')}")
        picture |= name == b"covr" and bool(value)
    return fields, picture


def embedded(body: bytes) -> tuple[dict[str, str], bool]:
    """(fields, has picture) of a file's tags: ID3v2 at its start or in a chunk, Vorbis comments of FLAC and Ogg, MP4
    atoms; nothing if there are none."""
    if body[:4] == b"fLaC":
        return _flac(body)
    if body[:4] == b"OggS":
        return _ogg(body)
    if body[4:8] == b"ftyp":
        return _mp4(body)
    at = body.find(b"ID3") if body[:3] == b"ID3" else -1
    if at < 0 and body[:4] in (b"RIFF", b"FORM"):
        for name, data in _chunks(body, body[:4] == b"RIFF"):
            if name.strip().lower() == b"id3":
                return embedded(data)
    if at < 0 or len(body) < 10:
        return {}, False
    version = body[3]
    size = sum((b & 0x7F) << s for b, s in zip(body[6:10], (21, 14, 7, 0), strict=True))
    tag, fields, picture, k, head = body[10 : 10 + size], {}, False, 0, 6 if version == 2 else 10
    while k + head <= len(tag) and tag[k] != 0:
        frame = tag[k : k + (3 if version == 2 else 4)].decode("latin-1")
        length = int.from_bytes(tag[k + 3 : k + 6], "big") if version == 2 else sum((b & 0x7F) << s for b, s in zip(tag[k + 4 : k + 8], (21, 14, 7, 0), strict=True)) if version == 4 else int.from_bytes(tag[k + 4 : k + 8], "big")
        data, k = tag[k + head : k + head + length], k + head + length
        frame = ID3_OLD.get(frame, frame)
        picture |= frame == "APIC"
        field = ID3_FRAMES.get(frame)
        if not field or not data or not (text := _id3_text(frame, data)):
            continue
        _put(fields, field, text)
    return fields, picture
