"""Conversations as ids, with tokens for roles and turns; and the lighter encode and decode that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PreprocessingConfig, special
from . import pretokenize
from .bpe import BpeModel
from .clean import clean

ROLES = ("user", "assistant", "system", "human", "ai", "bot", "prompter")


def role_token(role: Column) -> Column:
    """The special token of a role in any case; the user's for an unknown or missing one."""
    low = F.lower(role)
    return F.when(low.isin(*ROLES), F.concat(F.lit("<|"), low, F.lit("|>"))).otherwise(F.lit(special("user")))


def layout(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, messages): each conversation's array of (turn, role_token, content) in the order of turns. Null content is empty."""
    message = F.struct(F.col(turn_col).alias("turn"), role_token(F.col(role_col)).alias("role_token"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    return turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def _ids(model: BpeModel, token: Column) -> Column:
    """One-element array with a special token's id; empty if the model lacks it."""
    out = F.array().cast("array<int>")
    for name in (*ROLES, "startoftext", "turn"):
        if (i := model.vocab.get(special(name))) is not None:
            out = F.when(token == special(name), F.array(F.lit(i))).otherwise(out)
    return out


def encode_light(text: Column, model: BpeModel, config: PreprocessingConfig | None = None, add_special_tokens: bool = True) -> Column:
    """Cleaned, then encoded; with the start token in front unless it is there, if wanted and known."""
    ids = model.encode(clean(text, config) if config else text)
    start = model.vocab.get(special("startoftext"))
    if not add_special_tokens or start is None:
        return ids
    return F.when(F.get(ids, 0) == start, ids).otherwise(F.concat(F.array(F.lit(start)), ids))


def decode_light(ids: Column, model: BpeModel, skip_special_tokens: bool = True) -> Column:
    """Decoded, without special tokens other than those of the user, the assistant and the system."""
    if skip_special_tokens:
        keep = {special(n) for n in ("user", "assistant", "system")}
        gone = [i for t, i in model.config.special_tokens.items() if t not in keep]
        ids = F.filter(ids, lambda i: ~i.isin(gone)) if gone else ids
    return model.decode(ids)


def encode_conversations(turns: DataFrame, model: BpeModel, config: PreprocessingConfig | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids): start, then for every turn its role, its content and the end of the turn; tokens the model lacks are left out.

    Texts are brought together and encoded then, as four bytes an id are more than the letters it stands for.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = pretokenize.whole(clean(text, config) if config else text, model.config)
    turn = F.struct(F.col(turn_col).alias("turn"), role_token(F.col(role_col)).alias("token"), content.alias("content"))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.collect_list(turn).alias("m"))
    coded = grouped.withColumn("ids", model.encode_lists(F.transform("m", lambda m: pretokenize.cut(m["content"], model.config))))
    joined = F.zip_with("m", "ids", lambda m, ids: F.struct(m["turn"].alias("turn"), m["token"].alias("token"), F.concat(_ids(model, m["token"]), ids, _ids(model, F.lit(special("turn")))).alias("ids")))
    return coded.select("conv_id", F.concat(_ids(model, F.lit(special("startoftext"))), F.flatten(F.transform(F.sort_array(joined), lambda m: m["ids"]))).alias("ids"))
