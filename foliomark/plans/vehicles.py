"""The canonical tables, made from the given star-schema and text tables.

Each method maps one given table, whole, to a canonical table; keys and flags
come from its columns.  ``corpus`` brings them together in one id space.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import in_parts
from ..operators.documents import join_ocr_lines
from ..sources.corpus import spread
from .convert import DocumentTables

# Document ids in the corpus: 5 * id + place of its space in this list.
SPACES = ["documents", "orders", "conversations", "customers", "users"]

_SHAPE_ROWS = """
    array(array('Key', 'Total\\nprice'),
          array(cast(o_orderkey as string), concat('  ', o_orderstatus, ' '), 'extra'),
          array(cast(null as string), o_orderpriority),
          array(o_orderpriority))
"""
_SHAPE_PARAGRAPHS = """
    array(named_struct('level', 0, 'text', concat('  Order ', o_orderkey, ' ')),
          named_struct('level', cast(o_orderkey % 4 as int), 'text', concat('item  ', o_custkey)),
          named_struct('level', 1, 'text', '   '))
"""


class Vehicles:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def files(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id",
            """concat(source, '/Doc ', doc_id, element_at(
                 array('.pdf', '.PDF', '.pptx', '.ppt', '.png', '.JPEG', '.txt', ''),
                 cast(doc_id % 8 as int) + 1)) as path""",
        )

    def quick_text(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text"))

    def dirty_text(self) -> DataFrame:
        """Whole texts behind a head that gives every cleaning pass something to do."""
        return spread(self.table("documents")).selectExpr(
            "doc_id",
            """concat(chr(1), '  \\n## ## Doc ', doc_id, chr(127), '\\n\\n\\n\\n  • ', lang,
                 '\\n\\n * x   y\\n| a   b |\\n### ', source, '\\n#\\n##\\n', text, ' \\n') as text""",
        )

    def doc_pages(self) -> DataFrame:
        """Scanned pages: one per conversation turn."""
        return self.table("conversations").selectExpr(
            "conv_id as doc_id",
            "cast(turn as int) as page_no",
            "case when turn % 5 = 0 then ' \\n' end as embedded_text",
            "case when turn % 5 = 2 and role = 'user' then ' \\n ' else text end as ocr_text",
            "turn % 5 <> 4 as rasterized",
            "case when turn % 5 = 3 and role = 'assistant' then 'timeout' end as ocr_error",
            "turn % 5 = 1 and role = 'user' as block_error",
            "role <> 'system' as image_saved",
        )

    def blocks(self) -> DataFrame:
        """Positioned blocks: one per order line; the block number is unique."""
        return self.table("lineitem").selectExpr(
            "l_orderkey as doc_id",
            "cast(floor((l_linenumber - 1) / 3) as int) as page_no",
            """cast(l_linenumber as bigint) * 1000000000000000000
                 + l_partkey * 1000000000 + l_suppkey as block_no""",
            "case when l_returnflag = 'R' then 1 else 0 end as block_type",
            "l_quantity as x0",
            "l_extendedprice as y0",
            """case when l_quantity = 1 then '  '
                    when l_linestatus = 'F' then concat('• Part ', l_partkey, '\\n')
                    else concat('  Part ', l_partkey, '  as supplied by ', l_suppkey) end as text""",
        )

    def order_pages(self) -> DataFrame:
        """Three pages per order; those with status P have only blanks embedded and were read by OCR."""
        return self.table("orders").selectExpr(
            "o_orderkey as doc_id",
            "explode(array(0, 1, 2)) as page_no",
            """case when o_orderstatus = 'P' then ' - '
                    else concat('Order ', o_orderkey, ' of ', o_orderpriority, ' ') end as embedded_text""",
            """case when o_orderstatus = 'P' then concat('Scanned order ', o_orderkey, ' of ',
                    o_orderpriority, ' with a total price of ', cast(o_totalprice as bigint)) end as ocr_text""",
            "o_orderstatus <> 'F' as image_saved",
        ).selectExpr(
            "doc_id",
            "page_no",
            "embedded_text",
            "ocr_text",
            "true as rasterized",
            "cast(null as string) as ocr_error",
            "page_no = 2 and doc_id % 10 = 0 as block_error",
            "image_saved",
        )

    def table_rows(self) -> DataFrame:
        """Ragged, empty and header-only tables of two extractors: one row per part."""
        return self.table("part").selectExpr(
            "cast(floor(p_partkey / 40) as bigint) as doc_id",
            "cast(p_partkey % 3 as int) as page_no",
            "cast(p_size % 10 as int) as table_no",
            "case when p_type in ('ECONOMY', 'STANDARD') then 1 else 2 end as extractor",
            "p_partkey as row_no",
            """case when p_size % 10 = 4 then cast(array() as array<string>)
                    when p_partkey % 4 = 0 then array(p_name)
                    when p_partkey % 4 = 1 then array(p_name, null, 'x|y')
                    else array(p_name, p_brand) end as cells""",
        )

    def shapes(self) -> DataFrame:
        """Slide shapes: one per order, a deck per customer, a slide per month."""
        return spread(self.table("orders")).selectExpr(
            "o_custkey as doc_id",
            "month(o_orderdate) - 1 as page_no",
            "o_orderkey as shape_no",
            """case o_orderpriority when '2-HIGH' then 'TABLE' when '3-MEDIUM' then 'PICTURE'
                 when '5-LOW' then 'LINE' else 'TEXT' end as kind""",
            """concat(case when o_orderpriority <> '1-URGENT' then 'Content '
                 when o_orderstatus = 'F' then 'TÍTULO ' else 'Subtitle ' end, o_orderkey) as name""",
            """case when o_orderstatus <> 'P' then cast(floor(o_totalprice) as bigint) end as top""",
            "o_orderkey % 100 as left",
            f"{_SHAPE_PARAGRAPHS} as paragraphs",
            f"{_SHAPE_ROWS} as rows",
            """case when o_orderkey % 3 = 0 then ' \\n'
                 else concat('OCR of  ', o_orderkey) end as ocr_text""",
            "o_orderkey % 7 <> 0 as decoded",
            "o_orderstatus <> 'F' as saved",
            "case when o_orderkey % 5 = 0 then 'timeout' end as ocr_error",
            "case when o_orderkey % 11 = 0 then 'broken' end as error",
        )

    def shape_slides(self) -> DataFrame:
        return self._slides(self.shapes())

    def notes(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "conv_id as doc_id",
            "cast(turn as int) as page_no",
            "case when role = 'user' then concat(' \\n', text) else '  ' end as text",
        )

    def slides(self) -> DataFrame:
        """Slides that have a shape or a note."""
        return self._slides(self.shapes().select("doc_id", "page_no").union(
            self.notes().select("doc_id", "page_no")
        ))

    @staticmethod
    def _slides(content: DataFrame) -> DataFrame:
        return content.select("doc_id", "page_no").distinct().withColumn(
            "error", F.when((F.col("doc_id") + F.col("page_no")) % 9 == 0, "broken")
        )

    def ocr_lines(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id as doc_id",
            "cast(event_id % 3 as int) as page_no",
            "event_id as line_no",
            "event_type as text",
            "value / 100 as confidence",
        )

    def image_refs(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id as doc_id",
            "cast(event_id % 3 as int) as page_no",
            "event_id as image_no",
            "event_type <> 'error' as decoded",
            "value > 5 as saved",
        )

    def image_pages(self, **limits: int) -> DataFrame:
        """Image files: one per user, with the OCR text of all lines and sometimes a failure.

        A very long text keeps its parts.
        """
        lines = self.ocr_lines().withColumn("page_no", F.lit(0))
        return join_ocr_lines(lines, confident_only=True, **limits).selectExpr(
            "doc_id",
            "page_no",
            "part_no",
            "cast(null as string) as embedded_text",
            "case when doc_id % 5 = 1 then '' else text end as ocr_text",
            "true as rasterized",
            "case when doc_id % 5 = 2 then concat('engine stopped at ', doc_id) end as ocr_error",
            "false as block_error",
            "doc_id % 5 <> 3 as image_saved",
        )

    def photos(self) -> DataFrame:
        """The same image files, of which the engine's lines are still to be put in."""
        users = self.table("events").select(F.col("user_id").alias("doc_id")).distinct()
        return users.selectExpr(
            "doc_id",
            "0 as page_no",
            "cast(null as string) as embedded_text",
            "cast(null as string) as ocr_text",
            "true as rasterized",
            "case when doc_id % 5 = 2 then concat('engine stopped at ', doc_id) end as ocr_error",
            "false as block_error",
            "doc_id % 5 <> 3 as image_saved",
        )

    def photo_lines(self) -> DataFrame:
        return self.ocr_lines().where("doc_id % 5 <> 1").withColumn("page_no", F.lit(0))

    # Second tier of the documents space, for files whose quick text does not suffice: PDFs
    # (every third with embedded text) and images are one page, decks are one slide with notes.

    def file_pages(self) -> DataFrame:
        return self.table("documents").where("doc_id % 8 in (0, 1, 4, 5)").selectExpr(
            "doc_id",
            "0 as page_no",
            "case when doc_id % 8 < 2 and doc_id % 3 = 0 then text end as embedded_text",
            "case when doc_id % 8 > 1 or doc_id % 3 > 0 then text end as ocr_text",
            "true as rasterized",
            "cast(null as string) as ocr_error",
            "false as block_error",
            "doc_id % 2 = 0 as image_saved",
        )

    def file_blocks(self) -> DataFrame:
        return self.table("documents").where("doc_id % 8 < 2 and doc_id % 3 = 0").selectExpr(
            "doc_id", "0 as page_no", "0L as block_no", "0 as block_type", "0D as x0", "0D as y0", "text"
        )

    def file_notes(self) -> DataFrame:
        return self.table("documents").where("doc_id % 8 in (2, 3)").selectExpr(
            "doc_id", "0 as page_no", "text"
        )

    def file_slides(self) -> DataFrame:
        return self.file_notes().selectExpr("doc_id", "page_no", "cast(null as string) as error")

    def corpus(self, spaces: Sequence[str] = SPACES) -> DocumentTables:
        """All of the above as one corpus of five kinds of files, or only some spaces of it."""

        def placed(df: DataFrame, space: str) -> DataFrame:
            return df.withColumn("doc_id", F.col("doc_id") * 5 + SPACES.index(space))

        def together(**frames: DataFrame) -> DataFrame:
            chosen = {at: df for at, df in frames.items() if at in spaces}
            if not chosen:  # a table without rows
                chosen = {at: df.where(F.lit(False)) for at, df in list(frames.items())[:1]}
            return reduce(DataFrame.unionByName, [placed(df, at) for at, df in chosen.items()])

        def named(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
            path = F.concat(F.lit(before), F.col(key), F.lit(after))
            return df.select(F.col(key).alias("doc_id"), path.alias("path")).distinct()

        return DocumentTables(
            files=together(
                documents=self.files(),
                orders=named(self.table("orders"), "o_orderkey", "orders/Order: ", ".pdf"),
                conversations=named(self.table("conversations"), "conv_id", "scans/Scan ", ".PDF"),
                customers=named(self.table("orders"), "o_custkey", "decks/Deck ", ".pptx"),
                users=named(self.table("events"), "user_id", "photos/Photo? ", ".png"),
            ),
            quick_text=together(documents=self.quick_text()),
            doc_pages=together(
                documents=in_parts(self.file_pages()),
                orders=in_parts(self.order_pages()),
                conversations=in_parts(self.doc_pages()),
                users=in_parts(self.photos()),
            ),
            blocks=together(documents=self.file_blocks(), orders=self.blocks()),
            table_rows=together(orders=self.table_rows()),
            slides=together(documents=self.file_slides(), customers=self.shape_slides()),
            shapes=together(customers=self.shapes()),
            notes=together(documents=self.file_notes(), customers=self.notes()),
            image_refs=together(documents=self.image_refs(), orders=self.image_refs()),
            ocr_lines=together(users=self.photo_lines()),
        )
