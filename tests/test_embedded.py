import struct

from auralith.sources import audio


def comments(*pairs):
    out = struct.pack("<I", 3) + b"own" + struct.pack("<I", len(pairs))
    for p in pairs:
        out += struct.pack("<I", len(p.encode())) + p.encode()
    return out


PAIRS = ("TITLE= A title ", "artist=Someone", "Genre=Dark/Ambient", "DATE=2021-05-01", "TRACKNUMBER=3/12", "discnumber=1", "DISCTOTAL=2", "COMMENT=", "DESCRIPTION=Neon", "TITLE=Other", "UNKNOWN=x")
WANT = {"title": "A title", "artist": "Someone", "genre": "Dark/Ambient", "year": "2021", "track": "3", "track_total": "12", "disc": "1", "disc_total": "2", "comment": "Neon"}


def test_flac():
    block = comments(*PAIRS)
    body = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + bytes(34) + b"\x04" + len(block).to_bytes(3, "big") + block
    assert audio.embedded(body + b"\x86" + (4).to_bytes(3, "big") + b"pict") == (WANT, True)
    assert audio.embedded(body + b"\x81" + (4).to_bytes(3, "big") + b"pict") == (WANT, False)
    assert audio.embedded(b"fLaC") == ({}, False)


def page(packet, first=0):
    full, rest = divmod(len(packet), 255)
    sizes = bytes([255] * full + [rest])
    return b"OggS" + bytes(22) + bytes([len(sizes)]) + sizes + packet


def test_ogg():
    own = comments(*PAIRS, "LYRICS=" + "la " * 300)
    want = WANT | {"lyrics": ("la " * 300).strip()}
    assert audio.embedded(page(b"\x01vorbis" + bytes(23)) + page(b"\x03vorbis" + own)) == (want, False)
    assert audio.embedded(page(b"OpusHead" + bytes(11)) + page(b"OpusTags" + own)) == (want, False)
    assert audio.embedded(page(b"other")) == audio.embedded(page(b"other") * 2) == ({}, False)


def atom(name, data):
    return struct.pack(">I", 8 + len(data)) + name + data


def test_mp4():
    def item(name, value):
        return atom(name, atom(b"data", bytes(8) + value))

    own = item(b"\xa9nam", b" A title ") + item(b"\xa9ART", b"Someone") + item(b"\xa9day", b"2021-05-01") + item(b"trkn", bytes([0, 0, 0, 3, 0, 12, 0, 0])) + item(b"covr", b"png")
    body = atom(b"ftyp", b"M4A ") + atom(b"moov", atom(b"mvhd", bytes(8)) + atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", own))))
    assert audio.embedded(body) == ({"title": "A title", "artist": "Someone", "year": "2021", "track": "3", "track_total": "12"}, True)
    assert audio.embedded(atom(b"ftyp", b"M4A ")) == ({}, False)


def test_clap_tags(spark):
    from pyspark.sql import functions as F

    from auralith.operators import tagging

    kind = "id long, scores array<struct<label:string,score:float>>"
    df = spark.createDataFrame([(1, [("Sub_Bass", 0.5), ("pad", 0.48), ("bell", 0.1)]), (2, []), (3, None)], kind)
    found = {r["id"]: r["t"] for r in df.select("id", tagging.clap_tags(F.col("scores")).alias("t")).collect()}
    assert [(t["normalized_name"], t["source"], round(t["confidence"], 2)) for t in found[1]] == [("sub bass", "clap", 0.5), ("pad", "clap", 0.48)]
    assert found[2] == [] and found[3] is None
