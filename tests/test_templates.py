"""Templates with control flow, renaming a whole library, exports of one file."""

import csv
import json
import os

import pytest
from pyspark.errors import PySparkException

from auralith.api import new_library
from auralith.operators import rename

ROW = """select 7L id, 'Huge Pad.wav' file_name, 'wav' extension, 'wav' format, '/lib/a/Huge Pad.wav' path, 'a/Huge Pad.wav' relative_path, '/lib' source_root,
    2048L size_bytes, array('pad', 'dark') tags, map('key', 'F#') attributes, map('b', '2', 'a', '1') metadata,
    array(struct('rule' source, 'pad' name), struct('path' source, 'dark' name)) tag_rows"""
EMPTY = ROW.replace("array('pad', 'dark')", "cast(array() as array<string>)").replace("array(struct('rule' source, 'pad' name), struct('path' source, 'dark' name))", "cast(array() as array<struct<source:string,name:string>>)")

CASES = {
    "a {{- .Stem -}} b": "aHuge Padb",
    "{{/* a \" note */}}x": "x",
    "{{.ID}}/{{.SizeBytes}}": "7/2048",
    "{{.Tags}} {{.Metadata}}": "[dark pad] map[a:1 b:2]",
    "{{.Attributes.nope}}|{{index .Attributes \"nope\"}}": "<no value>|",
    "{{if .Tags}}{{index .Tags 0}}{{else}}none{{end}}": "dark",
    "{{if eq .Format \"aif\"}}A{{else if gt .SizeBytes 4096}}B{{else}}C{{end}}": "C",
    "{{if and .Tags (not .Attributes.nope) (le .SizeBytes 2048)}}yes{{end}}": "yes",
    "{{or .Attributes.nope .Stem}}": "Huge Pad",
    "{{and .Attributes.key 0}}": "0",
    "{{range $i, $t := .Tags}}{{if $i}}-{{end}}{{$t | upper}}{{end}}": "DARK-PAD",
    "{{range .Tags}}{{.}}@{{$.ID}} {{end}}": "dark@7 pad@7 ",
    "{{range $k, $v := .Metadata}}{{$k}}={{$v}};{{else}}none{{end}}": "a=1;b=2;",
    "{{range $s, $t := .TagsBySource}}{{$s}}:{{join $t \",\"}} {{end}}": "path:dark rule:pad ",
    "{{with .Attributes.key}}{{lower .}}{{else}}no key{{end}}": "f#",
    "{{with $x := .Attributes.nope}}{{$x}}{{else}}no key{{end}}": "no key",
    "{{$n := len .Tags}}{{$n}}": "2",
    "{{printf \"%05d_%-6s|%.2s|%v %% %q\" .ID .Format .Stem .Tags `a\"b`}}": '00007_wav   |Hu|[dark pad] % "a\\"b"',
    "{{slice .Stem 0 4}}{{slice .Tags 1}}": "Huge[pad]",
    "{{eq .Format \"mp3\" \"wav\"}}": "true",
    "{{join .TagsBySource.rule \"+\"}}{{.TagsBySource.none}}": "pad<no value>",
    "{{print .ID .SizeBytes .Format}}": "7 2048wav",
}
BARE = {
    "{{if .Tags}}x{{else}}none{{end}}": "none",
    "{{range .Tags}}x{{else}}none{{end}}": "none",
    "{{.Tags}}{{len .TagsBySource}}": "[]0",
}
BAD = ("{{", "{{if .Tags}}x", "{{end}}", "{{else}}", "{{if .Tags}}{{else}}{{else}}{{end}}", "{{range .ID}}{{end}}", "{{.Nope}}", "{{$x}}", "{{nope .Stem}}", "{{}}", "{{range .Tags}}{{.Stem}}{{end}}", '{{eq .ID "a"}}', '{{printf "%d" .Stem}}', '{{printf "%s"}}', "{{template \"x\"}}", "{{(.Stem}}")


def test_control_flow(spark):
    for row, cases in ((ROW, CASES), (EMPTY, BARE)):
        got = spark.sql(row).select(*[rename.render(t).alias(f"c{k}") for k, t in enumerate(cases)]).first()
        assert dict(zip(cases, got, strict=True)) == cases


@pytest.mark.parametrize("bad", BAD)
def test_refused(bad, spark):
    with pytest.raises(rename.TemplateError):
        rename.render(bad)


def test_out_of_range(spark):
    for bad in ("{{index .Tags 2}}", "{{slice .Stem 0 99}}"):
        with pytest.raises(PySparkException):
            spark.sql(ROW).select(rename.render(bad)).collect()


def test_whole_library(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name, when in (("One.wav", 1_000_000_000), ("two.wav", 1_100_000_000), ("three.aif", 1_200_000_000)):
        (root / name).write_bytes(name.encode())
        os.utime(root / name, (when, when))
    lib = new_library(spark, str(tmp_path / "lib"))
    assert lib.scan(str(root)) == 3
    lib.add_tag(f"{root}/two.wav", "Loud")
    template = "{{range .TagsBySource.manual}}{{.}}/{{else}}plain/{{end}}{{.Stem | lower}}"
    want = [(f"{root}/One.wav", f"{root}/plain/one.wav"), (f"{root}/three.aif", f"{root}/plain/three.aif"), (f"{root}/two.wav", f"{root}/loud/two.wav")]
    assert [tuple(r) for r in lib.rename_all(template).collect()] == want and os.path.exists(root / "One.wav")
    with pytest.raises(ValueError):
        lib.rename_all("{{.Format}}/same", dry_run=False)
    with pytest.raises(ValueError):
        lib.rename(f"{root}/One.wav", "two", dry_run=False)
    assert os.path.exists(root / "One.wav") and os.path.exists(root / "two.wav")
    assert [tuple(r) for r in lib.rename_all(template, dry_run=False).collect()] == want
    rows = lib.table("samples").selectExpr("path", "relative_path", "file_name", "format", "unix_timestamp(modified_at) t").orderBy("path").collect()
    assert [tuple(r) for r in rows] == [
        (f"{root}/loud/two.wav", "loud/two.wav", "two.wav", "wav", 1_100_000_000),
        (f"{root}/plain/one.wav", "plain/one.wav", "one.wav", "wav", 1_000_000_000),
        (f"{root}/plain/three.aif", "plain/three.aif", "three.aif", "aiff", 1_200_000_000),
    ]
    assert not os.path.exists(root / "One.wav") and (root / "plain" / "one.wav").read_bytes() == b"One.wav"

    lib.export(f"{tmp_path}/all.json", one_file=True)
    found = json.loads((tmp_path / "all.json").read_text())
    assert [x["Path"] for x in found] == [r["path"] for r in rows] and found[1]["SizeBytes"] == 7
    lib.export(f"{tmp_path}/all.csv", "csv", one_file=True)
    with open(tmp_path / "all.csv", newline="") as f:
        assert [x["path"] for x in csv.DictReader(f)] == [r["path"] for r in rows]
    empty = new_library(spark, str(tmp_path / "empty"))
    empty.export(f"{tmp_path}/none.json", one_file=True)
    assert json.loads((tmp_path / "none.json").read_text()) == []
    assert empty.rename_all(template, dry_run=False).count() == 0
