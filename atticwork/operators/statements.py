"""Bank statement rows as exchange records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines of the exchange format.
HEADER = ["1CClientBankExchange", "ВерсияФормата=1.03", "Кодировка=Windows"]
RECORD_START = "СекцияДокумент=Платежное поручение"
RECORD_END = "КонецДокумента"
SIDE = {"DEBIT": "Плательщик", "CREDIT": "Получатель"}


def plain_amount(amount: Column) -> Column:
    """Absolute amount without trailing zeros."""
    text = F.abs(amount).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def to_exchange(transactions: DataFrame, owner: dict[str, str]) -> DataFrame:
    """One multi-line record per transaction ``(account_id, TRNTYPE, DTPOSTED, TRNAMT, CHECKNUM, NAME)``.

    ``owner`` describes the account holder: bic, bank, corr_account, name, tax_id. A debit names the
    holder as payer, a credit as payee, other types name nobody.
    """
    day = F.concat_ws(".", F.substring("DTPOSTED", 7, 2), F.substring("DTPOSTED", 5, 2), F.substring("DTPOSTED", 1, 4))

    def party(kind: str) -> Column:
        s = SIDE[kind]
        fixed = [
            f"{s}БИК={owner['bic']}",
            f"{s}Банк1={owner['bank']}",
            f"{s}Корсчет={owner['corr_account']}",
            f"{s}1={owner['name']}",
            f"{s}ИНН={owner['tax_id']}",
        ]
        own = F.concat_ws("\n", *[F.lit(x) for x in fixed], F.concat(F.lit(f"{s}Счет="), F.col("account_id")))
        return F.when(F.col("TRNTYPE") == kind, own)

    record = F.concat_ws(
        "\n",
        F.lit(RECORD_START),
        F.concat(F.lit("Номер="), F.coalesce("CHECKNUM", F.lit(""))),
        F.concat(F.lit("НазначениеПлатежа="), F.coalesce("NAME", F.lit(""))),
        F.concat(F.lit("Дата="), day),
        F.concat(F.lit("Сумма="), plain_amount(F.col("TRNAMT"))),
        party("DEBIT"),
        party("CREDIT"),
        F.lit(RECORD_END),
    )
    return transactions.withColumn("record", record)


def exchange_header(accounts: DataFrame, sender: str, receiver: str) -> DataFrame:
    """One header block per account."""
    account = F.concat(F.lit("РасчСчет="), F.col("account_id"))
    block = F.concat_ws(
        "\n",
        *[F.lit(line) for line in HEADER],
        F.lit(f"Отправитель={sender}"),
        F.lit(f"Получатель={receiver}"),
        account,
        F.lit("СекцияРасчСчет"),
        account,
        F.lit("КонецРасчСчет"),
    )
    return accounts.select("account_id").distinct().withColumn("record", block)


def _with_offsets(data: bytes, lengths: np.ndarray, like: pa.Array) -> pa.Array:
    """Binary values of so many bytes each that lie one after another, null where they are null in an array as long."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(like), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.if_else(like.is_valid(), values, None).cast(pa.binary())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of binary values, and where each value starts and the last one ends."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint8), ends


def windows_1251(text: Column) -> Column:
    """Text whose bytes are those of the Windows Cyrillic code page, for a sink that writes bytes as they
    are. Characters the page does not have become question marks.

    All texts of a batch are translated at once: a character starts at every byte that does not go on with one.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw, ends = _bytes_of(batch)
            upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            yield _with_offsets(raw.tobytes().decode("utf-8").encode("cp1251", "replace"), np.diff(upto[ends]), batch)

    return run(F.make_valid_utf8(text).cast("binary")).cast("string")


def _upper_half() -> tuple[str, str]:
    """The characters above ASCII of the Windows Cyrillic code page, and the code points of their numbers."""
    upper = [(bytes([b]).decode("cp1251", "ignore"), chr(b)) for b in range(0x80, 0x100)]
    return "".join(c for c, _ in upper), "".join(m for c, m in upper if c)


def from_windows_1251(raw: Column) -> Column:
    """The text of bytes in the Windows Cyrillic code page that a text source has read as they are."""
    known, moved = _upper_half()
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), moved, known)


def write_exchange(
    transactions: DataFrame, owner: dict[str, str], sender: str, receiver: str, path: str, order: list[str],
    windows: bool = False,
) -> None:
    """Text files per account: header, then the records in order, written in parallel; UTF-8, or the
    Windows code page the format was made for.

    Range partitioning by (account, position) keeps one large account from being one task; the files of
    an account sort in order by name.
    """
    records = to_exchange(transactions, owner).select("account_id", F.lit(1).alias("_kind"), *order, F.col("record").alias("value"))
    heads = exchange_header(transactions, sender, receiver).select(
        "account_id", F.lit(0).alias("_kind"),
        *[F.lit(None).cast(transactions.schema[c].dataType).alias(c) for c in order],
        F.col("record").alias("value"),
    )
    keys = ["account_id", "_kind", *order]
    # Coded before the rows are put in order, which a step in Python does not keep for the writer.
    rows = heads.unionByName(records)
    rows = rows.withColumn("value", windows_1251(F.col("value"))) if windows else rows
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("account_id", "value").write.mode("overwrite").partitionBy("account_id").text(path)
