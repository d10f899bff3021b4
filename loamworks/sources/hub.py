"""Dataset hubs: cards, uploads and downloads through a transport of the caller's."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from loamworks.sources.sinks import write_splits


class Transport(Protocol):
    def ensure(self, repo: str, private: bool) -> None: ...
    def put(self, repo: str, local: str, remote: str) -> None: ...
    def get(self, repo: str, split: str) -> str: ...
    def url(self, repo: str) -> str: ...


class FolderTransport:
    """A hub that is a folder: for tests, and for shared disks."""

    def __init__(self, root: str) -> None:
        self.root = root

    def ensure(self, repo: str, private: bool = False) -> None:
        os.makedirs(f"{self.root}/{repo}", exist_ok=True)

    def put(self, repo: str, local: str, remote: str) -> None:
        import shutil

        target = f"{self.root}/{repo}/{remote}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.isdir(local):
            shutil.copytree(local, target, dirs_exist_ok=True)
        else:
            shutil.copyfile(local, target)

    def get(self, repo: str, split: str) -> str:
        return f"{self.root}/{repo}/data/{split}.jsonl"

    def url(self, repo: str) -> str:
        return f"file://{self.root}/{repo}"


def size_category(n: int) -> str:
    for limit, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K")):
        if n < limit:
            return name
    return "n>100K"


@dataclass
class DatasetCard:
    name: str
    description: str = ""
    language: Sequence[str] = ("en",)
    license: str = "mit"
    task_categories: Sequence[str] = ()
    task_ids: Sequence[str] = ()
    tags: Sequence[str] = ()
    size_categories: Sequence[str] = ()
    source_datasets: Sequence[str] = ()
    pretty_name: str | None = None
    more: dict[str, Any] = field(default_factory=dict)

    def to_yaml_header(self) -> str:
        lines = ["---"]
        for key in ("language", "task_categories", "task_ids", "tags", "size_categories", "source_datasets"):
            if values := getattr(self, key):
                lines += [f"{key}:", *[f"- {v}" for v in values]]
        lines += [f"license: {self.license}"]
        lines += [f"pretty_name: {title}" for title in [self.pretty_name] if title]
        return "\n".join([*lines, "---"])

    def to_readme(self) -> str:
        return f"{self.to_yaml_header()}\n\n# {self.pretty_name or self.name}\n\n{self.description}\n"


def _card(transport: Transport, repo: str, card: DatasetCard | None, staging: str) -> None:
    if card:
        local = f"{staging}.README.md"
        with open(local, "w", encoding="utf-8") as out:
            out.write(card.to_readme())
        transport.put(repo, local, "README.md")
        os.remove(local)


def upload_jsonl(transport: Transport, path: str, repo: str, split: str = "train", private: bool = False, card: DatasetCard | None = None) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    transport.ensure(repo, private)
    transport.put(repo, path, f"data/{split}.jsonl")
    _card(transport, repo, card, path.rstrip("/"))
    return transport.url(repo)


def upload_splits(transport: Transport, splits: dict[str, DataFrame], repo: str, staging: str, format: str = "jsonl", private: bool = False, card: DatasetCard | None = None) -> str:
    """Each split is written below `staging` and sent from there."""
    if format not in ("jsonl", "parquet"):
        raise ValueError(f"Unsupported format: {format}")
    transport.ensure(repo, private)
    for name, df in splits.items():
        local = f"{staging}/{name}.{format}"
        out = df.write.mode("overwrite")
        out.json(local) if format == "jsonl" else out.parquet(local)
        transport.put(repo, local, f"data/{name}.{format}")
    _card(transport, repo, card, f"{staging}/card")
    return transport.url(repo)


def upload_dataset(transport: Transport, df: DataFrame, repo: str, staging: str, format: str = "jsonl", split: str = "train", **options: Any) -> str:
    return upload_splits(transport, {split: df}, repo, staging, format, **options)


def upload_to_hub(transport: Transport, df: DataFrame, repo: str, staging: str, name: str, description: str = "", **options: Any) -> str:
    card = DatasetCard(name, description, size_categories=[size_category(df.count())])
    return upload_dataset(transport, df, repo, staging, card=card, **options)


def download(spark: SparkSession, transport: Transport, repo: str, split: str = "train", output: str | None = None) -> DataFrame:
    """The items of a split, written to `output` too if that is given."""
    items = spark.read.json(transport.get(repo, split))
    if output:
        items.write.mode("overwrite").json(output)
    return items


__all__ = ["DatasetCard", "FolderTransport", "Transport", "download", "size_category", "upload_dataset", "upload_jsonl", "upload_splits", "upload_to_hub", "write_splits"]
