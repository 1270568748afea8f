"""Command line: extract a dictionary from files, rewrite a file with it (plain or Typst)."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

import yaml

from .api import Anonymizer, anonymize_file, export_typst
from .operators.detect import CATEGORIES
from .sources import dictionary as K
from .sources import files


def _fail(message) -> None:
    print(f"Error: {message}")
    sys.exit(1)


def _guarded(run) -> None:
    try:
        run()
    except FileNotFoundError as e:
        _fail(f"File not found - {e}")
    except yaml.YAMLError as e:
        _fail(f"Error in YAML configuration: {e}")
    except Exception as e:  # noqa: BLE001  whatever it is, the exit status tells
        _fail(e)


def _loaded(config: str) -> Anonymizer:
    anonymizer = Anonymizer()
    if config.endswith(".parquet"):
        anonymizer.use_table(anonymizer.spark.read.schema(K.LONG).parquet(config))
    else:
        anonymizer.entities = K.from_yaml(Path(config).read_text(encoding="utf-8"))
    return anonymizer


def extract(paths: list[str], config: str = "__temp.yaml", language: str = "en") -> None:
    if not paths:
        _fail("At least one input file is required.")

    def run() -> None:
        anonymizer = Anonymizer(language)
        print("Reading input text files...")
        corpus = files.read_corpus(anonymizer.spark, paths).select("doc_id", "text")
        print(f"Detecting entities in {language}...")
        table = anonymizer.detect_documents(corpus)
        if config.endswith(".parquet"):  # of any size; not to be read by people
            table.write.mode("overwrite").parquet(config)
        else:
            anonymizer.entities = K.from_rows(table)
            files.write_text(config, anonymizer.generate_yaml())
        print("Detected entities:")
        for c in CATEGORIES:
            print(f"  {c.upper()} found: {anonymizer.counts[f'{c}_found']}")
        print(f"Config written to {config}")
        if not config.endswith(".parquet"):
            print(_shown(anonymizer.generate_yaml()))

    _guarded(run)


def _shown(text: str) -> str:
    """A preview; on a terminal, ids and variables stand out."""
    return re.sub(r"<[A-Z_]+_\d+>|#\([A-Z]+\d+V\d+\)", "\033[1;36m\\g<0>\033[0m", text) if sys.stdout.isatty() else text


def _report(counts: dict[str, int]) -> None:
    print("Replacement counts:")
    for c in CATEGORIES:
        print(f"  {c.upper()} replaced: {counts[f'{c}_replaced']}")


def plain(path: str, config: str | None, output: str | None = None) -> None:
    if config is None:
        _fail("--config is required")
    target = Path(output) if output else Path(path).parent / f"{Path(path).stem}_anon{Path(path).suffix}"

    def run() -> None:
        anonymizer = _loaded(config)
        print(f"Processing {path}...")
        _report(anonymize_file(path, anonymizer, target))
        print(_shown(target.read_text(encoding="utf-8")))

    _guarded(run)


def typst(path: str, config: str | None, output: str | None = None) -> None:
    if config is None:
        _fail("--config is required")

    def run() -> None:
        anonymizer = _loaded(config)
        print(f"Processing {path}...")
        counts, paths = export_typst(path, anonymizer, output)
        _report(counts)
        print(f"\nTypst files written to {paths[0].parent}")
        for p in paths:
            print(f" - {p}")
        for p in (paths[1], paths[2], paths[0]):
            print(f"\nPreview of {p.name}:\n{_shown(p.read_text(encoding='utf-8'))}")

    _guarded(run)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veilframe", description="Pseudonymise Markdown, plain text, TeX and BibTeX files.")
    commands = parser.add_subparsers(dest="command", required=True)
    x = commands.add_parser("extract", help="detect entities and write a dictionary")
    x.add_argument("files", nargs="*")
    x.add_argument("-c", "--config", default="__temp.yaml")
    x.add_argument("-l", "--language", default="en")
    kinds = commands.add_parser("pseudo", help="rewrite a file with a dictionary").add_subparsers(dest="kind", required=True)
    for kind in ("plain", "typst"):
        p = kinds.add_parser(kind)
        p.add_argument("file")
        p.add_argument("-c", "--config")
        p.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    if args.command == "extract":
        extract(args.files, args.config, args.language)
    else:
        {"plain": plain, "typst": typst}[args.kind](args.file, args.config, args.output)


if __name__ == "__main__":
    main()
