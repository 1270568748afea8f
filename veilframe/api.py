"""The session-level interface: detect in texts, review the dictionary, rewrite texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.text import hyphen_joined
from .operators import detect as D
from .operators import grouping, rewrite, typst
from .sources import dictionary as K
from .sources import files, folder


class Anonymizer:
    """Finds entities, numbers them, and replaces them by their ids. Counts are as of the last call (found adds up over detections)."""

    def __init__(self, language: str = "en", spark: SparkSession | None = None, registry: D.Registry | None = None):
        if language not in ("en", "da"):
            raise ValueError(f"no detectors for language {language}")
        self.language, self.registry = language, registry or D.Registry.default()
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.entities, self.table = K.Dictionary(), None
        self.counts = self._zero()

    @staticmethod
    def _zero() -> dict[str, int]:
        return {f"{c}_{what}": 0 for c in D.CATEGORIES for what in ("found", "replaced")}

    def _docs(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def preprocess_text(self, text: str):
        """The text that detection sees, and a function from its places to the original's."""
        from .functions.text import hyphen_cuts

        joined, cuts = self._docs([text]).select(hyphen_joined(F.col("text")), hyphen_cuts(F.col("text"))).first()

        def back(start: int, end: int) -> tuple[int, int]:
            if start >= len(joined):
                return len(text), len(text)
            last = end + 2 * sum(c < end for c in cuts) if 0 < end <= len(joined) else len(text)
            return start + 2 * sum(c <= start for c in cuts), last

        return joined, back

    def detect_documents(self, docs: DataFrame) -> DataFrame:
        """The dictionary (long form) of documents (doc_id, text)."""
        mentioned = grouping.kept(D.mentions(D.detect(docs, self.registry, self.language)))
        for r in D.found_counts(mentioned).collect():
            self.counts[f"{r.category}_found"] += r.found
        return grouping.dictionary(mentioned, [r.category for r in mentioned.select("category").distinct().collect()] or ["email_address"])

    def detect_entities(self, texts: list[str]) -> None:
        """Detects in texts, in their order, and adds the entities found to the dictionary."""
        self.entities.extend(K.from_rows(self.detect_documents(self._docs(texts))))

    def generate_yaml(self) -> str:
        return K.to_yaml(self.entities)

    def load_replacements(self, config: dict) -> None:
        self.entities, self.table = K.Dictionary(config), None

    def use_table(self, table: DataFrame) -> None:
        """A dictionary in long form (as of detect_documents) instead of one on the driver: it may be of any size."""
        self.table = table

    def dictionary(self) -> DataFrame:
        return K.to_rows(self.spark, self.entities) if self.table is None else self.table

    def anonymize_documents(self, docs: DataFrame) -> DataFrame:
        return rewrite.pseudonymize(docs, self.dictionary())

    def anonymize(self, text: str) -> tuple[str, dict[str, int]]:
        r = self.anonymize_documents(self._docs([text])).first()
        self.counts = self._zero()
        for c, n in r.counts.items():
            self.counts[f"{c}_found"] = self.counts[f"{c}_replaced"] = n
        return r.text, dict(self.counts)


def extract_text(path, spark: SparkSession | None = None) -> str:
    return files.read_corpus(spark or SparkSession.builder.getOrCreate(), [path]).first().text


def anonymize_file(path, anonymizer: Anonymizer, output) -> dict[str, int]:
    """Rewrites a file (of BibTeX each field of each entry); the counts of all its texts."""
    path = files.checked(path)
    raw = files.read_raw(anonymizer.spark, [path])
    if path.suffix == ".bib":
        rows, seen = rewrite.observed(anonymizer.anonymize_documents(files.bib_fields(raw)))
        fields = grouping.kept(rows)
        row = files.bib_text(fields.select("doc_id", "entry_no", "field_no", "field", "text")).first()
        text = row.text if row else ""
    else:
        rows, seen = rewrite.observed(anonymizer.anonymize_documents(raw.select("doc_id", "text")))
        text = grouping.kept(rows).first().text
    files.write_text(output, text)
    return _counts(seen)


def anonymize_folder(path: str, anonymizer: Anonymizer, output: str) -> dict[str, int]:
    """Rewrites all files of a folder into another, under their paths within it; of BibTeX each field of each entry. Tasks read and write the files."""
    raw = folder.read_folder(anonymizer.spark, path)
    fields = files.bib_fields(raw.where("fmt = 'bib'"))
    rest = raw.where("fmt <> 'bib'").select("doc_id", F.lit(0).alias("entry_no"), F.lit(0).alias("field_no"), F.lit(None).cast("string").alias("field"), "text")
    rows, seen = rewrite.observed(anonymizer.anonymize_documents(fields.unionByName(rest)))
    done = grouping.kept(rows.select("doc_id", "entry_no", "field_no", "field", "text"))
    texts = files.bib_text(done.where("field IS NOT NULL")).unionByName(done.where("field IS NULL").select("doc_id", "text"))
    name = F.col("path").substr(F.lit(len(folder.top(path)) + 2), F.length("path"))
    named = raw.select(F.col("doc_id").alias("_id"), name.alias("name")).join(texts, F.col("_id") == F.col("doc_id"), "left")  # a file without entries has no row
    folder.write_folder(named.select("name", F.coalesce("text", F.lit("")).alias("text")), output)
    return _counts(seen)


def _counts(seen: Observation) -> dict[str, int]:
    return Anonymizer._zero() | {f"{c}_{what}": n for c, n in seen.get.items() for what in ("found", "replaced")}


def md_to_typst(md: str, spark: SparkSession | None = None) -> str:
    from .functions.text import typst_markup

    spark = spark or SparkSession.builder.getOrCreate()
    return spark.createDataFrame([(md,)], "t string").select(typst_markup(F.col("t"))).first()[0]


def export_typst(path, anonymizer: Anonymizer, output=None) -> tuple[dict[str, int], tuple[Path, Path, Path]]:
    """Writes the main, the variables' and the fake variables' file; the counts and the three paths."""
    path = Path(path)
    main = Path(output) if output else path.with_suffix(".typ")
    if main.suffix != ".typ":
        raise ValueError("Output file must end with .typ")
    if path.suffix not in (".md", ".txt"):
        raise ValueError("Typst export currently supported only for .md and .txt files.")
    real, fake = main.parent / f"{main.stem}_vars.typ", main.parent / f"{main.stem}_fakevars.typ"
    entities = anonymizer.dictionary()
    named = grouping.kept(typst.variables(entities))
    raw = files.read_raw(anonymizer.spark, [path]).select("doc_id", "text")
    rows, seen = rewrite.observed(typst.with_variables(raw, entities))
    done = grouping.kept(rows.withColumn("main", typst.main_text(F.col("text"), real.name, path.suffix == ".md")))
    main.parent.mkdir(parents=True, exist_ok=True)
    lines = named.orderBy("ord").select(typst.let_line(F.col("var"), F.col("real_value")), typst.let_line(F.col("var"), F.col("fake_value")))
    with open(real, "w", encoding="utf-8", newline="") as r, open(fake, "w", encoding="utf-8", newline="") as f:
        for x in lines.toLocalIterator():  # a part at a time, however large the dictionary
            r.write(x[0])
            f.write(x[1])
    files.write_text(main, done.first().main)
    return _counts(seen), (main, real, fake)
