"""A PySpark-native engine that turns documents into training datasets."""

__version__ = "0.1.0"

#: The public names, each taken from its module when it is first asked for.
_WHERE = {
    "plans.pipeline": "Processor process",
    "operators.dataset": "Dataset",
    "operators.quality": "DuplicateFilter QualityFilterPipeline QualityScorer default_filters",
    "functions.verdicts": "ContentFilter LanguageFilter LengthFilter QASpecificFilter RepetitionFilter TokenLengthFilter",
    "functions.formats": "format_items",
    "operators.jobs": "Jobs",
    "operators.extraction": "ask extract get_extractor",
    "operators.augmentation": "Augmenter synonym_augmenter",
    "operators.parallel": "apply apply_batches",
    "sources.loaders": "load_document load_folder register_loader",
    "sources.hub": "DatasetCard FolderTransport",
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_MODULE[name]}"), name)
