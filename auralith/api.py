"""The engine's verbs over a folder of Parquet tables: scan, analyze, tag, similar, cluster, dedup, convert, rename, export, browse.

Verbs that change files only say what they would do unless dry_run is False.
"""

from __future__ import annotations

import csv
import os
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith import schemas
from auralith.functions.exprs import FORMATS, normalize_name, timestamp_text
from auralith.operators import analyzers, catalog, clustering, components, dedup, rename, serving, similarity, tagging
from auralith.sources import scan as scanning


def _form(path: str) -> str:
    return FORMATS.get(Path(path).suffix.lower().lstrip("."), "unknown")


def convert_target(path: str, output: str = "", form: str = "") -> tuple[str, str]:
    """(output path, format) of a conversion. One of output and form must be given; if both are, they must agree."""
    if form.strip():
        if (named := FORMATS.get(form.strip().lower())) is None:
            raise ValueError(f"unsupported target format {form!r}")
        if not output:
            return str(Path(path).with_suffix(f".{named}")), named
        if not Path(output).suffix:
            return f"{output}.{named}", named
        if _form(output) != named:
            raise ValueError(f"output {output!r} does not match format {form!r}")
        return output, named
    if not output:
        raise ValueError("choose an output or a format")
    if (found := _form(output)) == "unknown":
        raise ValueError(f"cannot tell the format of {output!r}")
    return output, found


class Library:
    """A catalog: one folder a table, replaced as a whole by each change."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The table's current version; empty if there is none."""
        versions = self._versions(name)
        return self.spark.read.schema(schemas.TABLES[name]).parquet(versions[-1]) if versions else self.spark.createDataFrame([], schemas.TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.TABLES}

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[str]:
        fs, path = self._files()
        found = fs.globStatus(path(f"{self.folder}/{name}/v=*/_SUCCESS"))
        return sorted(str(s.getPath().getParent()) for s in found) if found else []

    def put(self, name: str, df: DataFrame) -> None:
        """Writes a new version beside the old one, which readers keep until it is complete."""
        columns = [c.strip().split()[0] for c in schemas.TABLES[name].replace("map<string,double>", "map").split(",")]
        whole = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in columns])
        versions = self._versions(name)
        number = int(versions[-1].rsplit("=", 1)[1]) + 1 if versions else 1
        target = self.spark.createDataFrame([], schemas.TABLES[name]).schema
        whole.select(*[F.col(f.name).cast(f.dataType) for f in target]).write.parquet(f"{self.folder}/{name}/v={number:08d}")
        fs, path = self._files()
        for old in versions[:-1]:
            fs.delete(path(old), True)

    def scan(self, *roots: str, include_hidden: bool = False, follow_symlinks: bool = False) -> int:
        found = scanning.scan(self.spark, *roots, include_hidden=include_hidden, follow_symlinks=follow_symlinks).withColumn("scanned_at", F.current_timestamp()).withColumn("id", F.lit(None).cast("long"))
        found = components.keep(found, components.scratch(self.spark, "scan"))  # the roots are walked once
        self.put("samples", catalog.upsert_samples(self.table("samples"), found))
        return found.count()

    def _contents(self, samples: DataFrame) -> DataFrame:
        """Samples with their bytes, read where the tasks run."""
        columns = samples.select("id", "path", "format", "extension")

        def read(batches):
            for pdf in batches:
                for k in range(len(pdf)):
                    row = pdf.iloc[k : k + 1].copy()
                    row["content"] = [Path(row["path"].iloc[0]).read_bytes()]
                    yield row

        return columns.mapInPandas(read, "id long, path string, format string, extension string, content binary")

    def analyze(self, sample_id: int | None = None, mode: str = "FAILFAST", dry_run: bool = False) -> DataFrame:
        own = self.table("samples")
        if sample_id is not None:
            own = own.where(F.col("id") == sample_id)
            if not own.head(1):
                raise LookupError(f"sample {sample_id} is not indexed")
        found = analyzers.analyze_files(self._contents(own), mode)
        if not dry_run:
            found = components.keep(found, components.scratch(self.spark, "analysis"))  # every file is decoded once
            self.put("feature_vectors", catalog.replace_vectors(self.table("feature_vectors"), analyzers.feature_vectors(found)))
        return found

    def info(self, path: str) -> tuple[dict, dict, str]:
        """Metrics, attributes and hash of one file, without the catalog."""
        suffix = Path(path).suffix.lower().lstrip(".")
        return analyzers.analyze_bytes(Path(path).read_bytes(), FORMATS.get(suffix, "unknown"), suffix)

    def auto_tag(self, rules: list[dict] | None = None, mode: str = "FAILFAST", path: str | None = None, scores: DataFrame | None = None, labels: list[str] | None = None, floor: float = tagging.CLAP_FLOOR, limit: int = tagging.CLAP_LIMIT) -> None:
        """Metadata tags, then rules, then the best labels, written and attached; of one path or of all samples.

        scores (id, scores array of (label, score)) are what the audio-text encoder gives (functions/clap.py);
        labels says that they are of given labels, not of the default ones."""
        own = self.table("samples")
        if path is not None:
            own = catalog.sample_by_path(own, path)
            if not own.head(1):
                raise LookupError(f"{path!r} is not indexed")
        found = analyzers.analyze_files(self._contents(own), mode, ("spectral", "dynamics", "pitch", "key", "harmonics")).drop("hash", "error")
        rows = own.join(found, "id")
        kind = "array<struct<name:string,normalized_name:string,source:string,confidence:double>>"
        parts = [tagging.metadata_tags(F.col("attributes")), tagging.rule_tags(rules or []).cast(kind)]
        if scores is not None:
            rows = rows.join(scores.select("id", "scores"), "id", "left")
            parts.append(F.coalesce(tagging.clap_tags(F.col("scores"), labels is None, floor, limit), F.array().cast(kind)))
        merged = tagging.merge_tags(*parts)
        self._write_tags(rows.select(F.col("id").alias("sample_id"), F.posexplode(merged).alias("k", "t")).select("sample_id", F.struct("sample_id", "k").alias("turn"), "t.*"))

    def _write_tags(self, rows: DataFrame) -> None:
        old = self.table("tags")
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = rows.groupBy("normalized_name").agg(F.max_by(F.struct("name", "source", "confidence"), "turn").alias("t"), F.min("turn").alias("first"))
        known = new.join(old.select("normalized_name", "id"), "normalized_name").select("id", "t.name", "normalized_name", "t.source", "t.confidence")
        fresh = catalog.numbered(new.join(old, "normalized_name", "left_anti"), "id", ["first"], last).select("id", "t.name", "normalized_name", "t.source", "t.confidence")
        kept = old.join(new, "normalized_name", "left_anti").select("id", "name", "normalized_name", "source", "confidence")
        self.put("tags", kept.unionByName(known).unionByName(fresh))
        pairs = rows.join(self.table("tags").select(F.col("id").alias("tag_id"), "normalized_name"), "normalized_name").select("sample_id", "tag_id")
        self.put("sample_tags", catalog.attach_tags(self.table("sample_tags"), pairs))

    def add_tag(self, path: str, name: str) -> None:
        own = catalog.sample_by_path(self.table("samples"), path)
        if not own.head(1):
            raise LookupError(f"{path!r} is not indexed")
        self._write_tags(own.select(F.col("id").alias("sample_id"), F.struct(F.lit(0)).alias("turn"), F.lit(name).alias("name"), normalize_name(F.lit(name)).alias("normalized_name"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence")))

    def remove_tag(self, path: str, name: str) -> None:
        """The tag is written as a manual one first, as when it is added."""
        self.add_tag(path, name)
        own = catalog.sample_by_path(self.table("samples"), path).select(F.col("id").alias("sample_id"))
        tag = catalog.tag_by_name(self.table("tags"), name).select(F.col("id").alias("tag_id"))
        gone = self.table("sample_tags").join(own, "sample_id", "left_semi").join(tag, "tag_id", "left_semi").select("sample_id", "tag_id")
        self.put("sample_tags", catalog.remove_tags(self.table("sample_tags"), gone))

    def tags(self) -> DataFrame:
        return serving.tags(self.tables())

    def similar(self, *references: str, limit: int = 25, threshold: float = 0.0, order: str = "desc") -> DataFrame:
        """(similarity, ref_path, path): the samples most like any reference, given as ids, paths or names."""
        samples = self.table("samples")
        ids = [r["sample_id"] for r in similarity.resolve_references(list(references), samples).orderBy("position").collect()]
        vectors = catalog.vectors_in(self.table("feature_vectors"), schemas.VECTOR_NAMESPACE).select("sample_id", "values")
        found = similarity.similar_to(vectors, ids, 0, threshold, order)
        named = found.join(samples.select(F.col("id").alias("sample_id"), "path"), "sample_id").join(samples.select(F.col("id").alias("ref_id"), F.col("path").alias("ref_path")), "ref_id")
        ordered = named.orderBy(F.desc("similarity") if order == "desc" else F.asc("similarity"), "path", "ref_path").select("similarity", "ref_path", "path")
        return ordered.limit(limit) if limit else ordered

    def cluster(self, k: int = 8, projection: str = "pca", dry_run: bool = False) -> DataFrame:
        vectors = catalog.vectors_in(self.table("feature_vectors"), schemas.VECTOR_NAMESPACE).select("sample_id", "values")
        found = clustering.kmeans(vectors, k)
        points = clustering.project_2d(vectors, projection)
        members = clustering.cluster_scores(found.memberships)
        centres = clustering.centroids_2d(members.withColumnRenamed("cluster", "cluster_id"), points).drop("n")
        rows = clustering.cluster_rows(found.memberships, "kmeans", {"k": k, "iterations": found.iterations}).join(centres, F.col("cluster") == centres["cluster_id"], "left")
        extra = F.map_filter(F.create_map(F.lit("projection_x"), F.col("projection_x"), F.lit("projection_y"), F.col("projection_y")), lambda _, v: v.isNotNull())
        rows = rows.select("cluster", "method", "label", "size", F.map_concat("params", extra).alias("params"))
        if not dry_run:
            old = self.table("clusters").where("method <> 'kmeans'")
            last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            kept = self.table("cluster_members").join(old.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
            new = members.select((F.col("cluster") + last + 1).cast("long").alias("cluster_id"), "sample_id", "score")
            self.put("cluster_members", kept.unionByName(new, allowMissingColumns=True))
            self.put("clusters", old.unionByName(rows.select((F.col("cluster") + last + 1).cast("long").alias("id"), "method", "label", "params"), allowMissingColumns=True))
        return rows

    def dedup(self, exact: bool = False, perceptual: bool = False, threshold: int = dedup.DEFAULT_DISTANCE, keep: str = "first-path", delete: bool = False, dry_run: bool = True) -> DataFrame:
        """Duplicates with keep_path and remove, exact ones by size and hash, near ones by group size; with delete and not dry_run the files and rows to remove go."""
        if exact == perceptual:
            raise ValueError("choose exactly one of exact and perceptual")
        samples = self.table("samples")
        if exact:
            content = self._contents(dedup.size_candidates(samples)).select("id", "content")
            plan = dedup.plan_cull(dedup.exact_duplicates(samples.join(content, "id")), ["size_bytes", "sha256"], keep).orderBy("size_bytes", "sha256", "path")
        else:
            hashed = analyzers.analyze_files(self._contents(samples), which=()).select("id", F.conv("hash", 16, -10).cast("long").alias("bits"))
            plan = dedup.plan_cull(dedup.perceptual_groups(samples.join(hashed, "id").select("id", "path", "bits", "modified_at"), threshold), ["ref_path"], keep).orderBy(F.desc("n"), "ref_path", "distance", "path")
        if delete and not dry_run:
            plan = components.keep(plan, components.scratch(self.spark, "cull"))  # it must not be made again from files that are gone
            for r in plan.where("remove").select("path").toLocalIterator():
                Path(r["path"]).unlink(missing_ok=True)
            left = catalog.delete_sample(self.tables(), plan.where("remove").select(F.col("id").alias("sample_id")))
            for name in ("sample_tags", "feature_vectors", "cluster_members", "samples"):
                self.put(name, left[name])
        return plan

    def _targets(self, samples: DataFrame, template: str) -> DataFrame:
        """(id, path, source_root, target) of samples; attributes and metadata, which the catalog does not keep, are empty."""
        named = self.table("sample_tags").join(self.table("tags").select(F.col("id").alias("tag_id"), "source", F.col("normalized_name").alias("name")), "tag_id")
        sources = named.groupBy("sample_id").agg(F.collect_set(F.struct("source", "name")).alias("tag_rows"))
        own = catalog.samples_with_tags(samples, self.table("tags"), self.table("sample_tags")).join(sources.withColumnRenamed("sample_id", "id"), "id", "left")
        none, no_tags = F.create_map().cast("map<string,string>"), F.array().cast("array<struct<source:string,name:string>>")
        given = own.withColumns({"attributes": none, "metadata": none, "tag_rows": F.coalesce("tag_rows", no_tags)})
        return given.select("id", "path", "source_root", rename.rename_target(rename.render(template), F.col("source_root"), F.col("extension")).alias("target"))

    def rename(self, path: str, template: str, dry_run: bool = True) -> str:
        """The sample's new path; with dry_run False the file is moved and its row follows."""
        row = self._targets(catalog.sample_by_path(self.table("samples"), path), template).first()
        if row is None:
            raise LookupError(f"{path!r} is not indexed")
        if not dry_run:
            self._move(self._targets(catalog.sample_by_path(self.table("samples"), path), template))
        return row["target"]

    def rename_all(self, template: str, dry_run: bool = True) -> DataFrame:
        """(path, target) of all samples by path; with dry_run False the files are moved and their rows follow.

        Nothing is moved if two samples would get one path, or one the path of another."""
        plan = components.keep(self._targets(self.table("samples"), template), components.scratch(self.spark, "rename"))
        if not dry_run:
            self._move(plan)
        return plan.select("path", "target").orderBy("path")

    def _move(self, plan: DataFrame) -> None:
        """Moves files where the tasks run. A move that a lost task had done already is not done again."""
        samples = self.table("samples")
        taken = plan.groupBy("target").count().where("count > 1").select("target")
        held = plan.where("path <> target").join(samples.select(F.col("path").alias("target")), "target", "left_semi").select("target")
        if clash := taken.unionByName(held).orderBy("target").first():
            raise ValueError(f"more than one sample for {clash['target']!r}")
        plan = components.keep(plan.where("path <> target"), components.scratch(self.spark, "moves"))

        def move(batches):
            for pdf in batches:
                found = []
                for old, new, root in zip(pdf["path"], pdf["target"], pdf["source_root"], strict=True):
                    if os.path.exists(old) or not os.path.exists(new):
                        os.makedirs(os.path.dirname(new), exist_ok=True)
                        os.replace(old, new)
                    stat = os.stat(new)
                    found.append((new, os.path.relpath(new, root), os.path.basename(new), stat.st_size, stat.st_mtime))
                yield pd.DataFrame(found, columns=["path", "relative_path", "file_name", "size_bytes", "modified"]).assign(id=pdf["id"].to_numpy())

        moved = components.keep(plan.mapInPandas(move, "id long, path string, relative_path string, file_name string, size_bytes long, modified double"), components.scratch(self.spark, "moved"))
        self.put("samples", catalog.update_locations(samples, moved.withColumn("modified_at", F.timestamp_micros((F.col("modified") * 1e6).cast("long"))).drop("modified")))

    def convert(self, path: str, output: str = "", form: str = "", **options) -> str:
        """Writes the converted file and returns its path: output, or the source's with the format's extension."""
        target, form = convert_target(path, output, form)
        files = self.spark.createDataFrame([(0, bytearray(Path(path).read_bytes()), _form(path))], "id long, content binary, format string")
        Path(target).write_bytes(bytes(analyzers.convert_files(files, form, **options).first()["content"]))
        return target

    def export(self, output: str, form: str = "json", one_file: bool = False) -> None:
        """All samples by path as a folder of JSON lines or CSV files, or with one_file as one JSON array or one CSV file,
        which the driver writes row by row."""
        own = catalog.list_samples(self.table("samples"))
        times = {c: timestamp_text(F.col(c)).alias(c) for c in ("modified_at", "scanned_at")}
        text = own.select(*[times.get(c, F.col(c)) for c in own.columns])
        if form == "json":
            named = {"id": "ID", "size_bytes": "SizeBytes"}
            text = text.select(*[F.col(c).alias(named.get(c, "".join(w.capitalize() for w in c.split("_")))) for c in own.columns])
        elif form != "csv":
            raise ValueError(f"unsupported export format {form!r}")
        if one_file:
            self._export_file(text, output, form)
        elif form == "csv":
            text.write.option("header", True).csv(output)
        else:
            text.write.json(output)

    def _export_file(self, rows: DataFrame, output: str, form: str) -> None:
        with open(output, "w", encoding="utf-8", newline="") as f:
            if form == "csv":
                out = csv.writer(f, lineterminator="\n")
                out.writerow(rows.columns)
                for row in rows.toLocalIterator():
                    out.writerow(["" if v is None else v for v in row])
                return
            f.write("[")
            for k, row in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).toLocalIterator()):
                f.write(",\n" if k else "\n")
                f.write(row["json"])
            f.write("\n]\n")

    def browse(self, query: str = "", tags: tuple[str, ...] = (), limit: int = 25) -> DataFrame:
        return catalog.browse(serving.samples(self.tables()), query, list(tags), limit)

    def play_target(self, name: str) -> str:
        """A file as it is, else the first sample with the tag."""
        if os.path.isfile(name):
            return name
        found = catalog.playback_target(self.table("samples"), self.table("tags"), self.table("sample_tags"), name).first()
        if found is None:
            raise LookupError(f"no file and no tag {name!r}")
        return found["path"]


def new_library(spark: SparkSession, base: str) -> Library:
    return Library(spark, f"{base.rstrip('/')}/library-{uuid.uuid4().hex}")
