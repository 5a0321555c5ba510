"""Lodestone: a Spark-native engine for preparing text corpora and training, applying and evaluating tokenizers."""

import logging
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Worker functions travel inside the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .catalog import Catalog, Collection, Entry, create_tokenizer_from_config, get_catalog, get_tokenizer_info, list_tokenizers, load_tokenizer, register_tokenizer, search_tokenizers  # noqa: E402
from .config import PreprocessingConfig, TokenizerConfig, chat_config  # noqa: E402
from .operators.analyze import tokenization_quality, validate  # noqa: E402
from .operators.bpe import BpeModel, UntrainedError, build, merge_models, train  # noqa: E402
from .plans.pipeline import prepare, preprocessing, train_simple  # noqa: E402

Tokenizer, Config = BpeModel, TokenizerConfig


def get_version() -> str:
    return __version__


def get_available_tokenizers() -> list[str]:
    return list_tokenizers()


def quick_tokenize(text: str, tokenizer: str | BpeModel = "gpt2-small", return_tokens: bool = False) -> list:
    """Ids, or tokens, of one text, on the driver. A catalog entry without a trained file, or an unknown name, is trained on the text itself."""
    try:
        model = load_tokenizer(tokenizer) if isinstance(tokenizer, str) else tokenizer
    except ValueError:
        model = BpeModel()
    if not model.trained:
        import regex

        words: dict[str, int] = {}
        for w in regex.findall(model.config.regex_pattern, text):
            words[w] = words.get(w, 0) + 1
        model = build(words.items(), model.config.with_(min_frequency=1))
    ids = model.encode_text(text)
    return [model.id_to_token(i) or f"<{i}>" for i in ids] if return_tokens else ids


def setup_logging(level: str = "INFO", format_string: str | None = None) -> None:
    logging.basicConfig(level=getattr(logging, level.upper()), format=format_string or "%(asctime)s %(name)s %(levelname)s %(message)s", force=True)


def print_info() -> None:
    print(f"lodestone {__version__}; tokenizers: {', '.join(get_available_tokenizers())}")


__all__ = [
    "BpeModel", "Catalog", "Collection", "Config", "Entry", "PreprocessingConfig", "Tokenizer", "TokenizerConfig", "UntrainedError", "build", "chat_config", "create_tokenizer_from_config",
    "get_available_tokenizers", "get_catalog", "get_tokenizer_info", "get_version", "list_tokenizers", "load_tokenizer", "merge_models", "prepare", "preprocessing", "print_info", "quick_tokenize",
    "register_tokenizer", "search_tokenizers", "setup_logging", "tokenization_quality", "train", "train_simple", "validate",
]
