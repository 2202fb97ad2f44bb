"""The typed record of one source file, and the tables it becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFINITION = "struct<kind:string,name:string,fqn:string,parent:string,ordinal:int,start_line:int,end_line:int,signature:string,doc:string,modifiers:string,exported:boolean,declared_type:string,meta:map<string,string>>"
REFERENCE = "struct<kind:string,name:string,qualifier:string,scope:string,line:int,arity:int>"
IMPORT = "struct<source:string,alias:string,kind:string,names:array<struct<name:string,alias:string>>,namespace:boolean,line:int,relative_level:int>"
LOCAL_TYPE = "struct<scope:string,name:string,type:string,via:string>"
FILE_IR = f"path string, language string, hash string, doc string, error_pct int, is_test boolean, definitions array<{DEFINITION}>, refs array<{REFERENCE}>, imports array<{IMPORT}>, local_types array<{LOCAL_TYPE}>"


def symbols(ir: DataFrame) -> DataFrame:
    """id, file and the definition's fields of every definition, and a module row a file at ordinal -1.

    An id is file::fqn; the k-th repeat within a file, by ordinal, ends in #k from #2 on.
    """
    d = ir.select(F.col("path").alias("file"), "language", "is_test", F.explode("definitions").alias("d")).select("file", "language", "is_test", "d.*")
    k = F.row_number().over(Window.partitionBy("file", "fqn").orderBy("ordinal"))
    d = d.withColumn("k", k).withColumn("id", F.concat("file", F.lit("::"), "fqn", F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")))
    d = d.withColumn("parent", F.when(F.col("parent").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("::"), "parent")))
    d = d.withColumn("doc", F.substring("doc", 1, 2000)).drop("k")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    empty = F.lit(None).cast("string")
    module = ir.select(F.col("path").alias("file"), "language", "is_test", F.lit("module").alias("kind"), name.alias("name"), F.col("path").alias("fqn"), empty.alias("parent"), F.lit(-1).alias("ordinal"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("signature"), F.substring("doc", 1, 2000).alias("doc"), F.lit("").alias("modifiers"), F.lit(True).alias("exported"), empty.alias("declared_type"), F.lit(None).cast("map<string,string>").alias("meta"), F.col("path").alias("id"))
    return d.unionByName(module)


def references(ir: DataFrame) -> DataFrame:
    return ir.select(F.col("path").alias("file"), "language", "is_test", F.posexplode("refs").alias("pos", "r")).select("file", "language", "is_test", "pos", "r.*").withColumn("scope", F.when(F.col("scope").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("::"), "scope")))


def imports(ir: DataFrame) -> DataFrame:
    return ir.select(F.col("path").alias("file"), "language", F.posexplode("imports").alias("pos", "i")).select("file", "language", "pos", "i.*")


def local_types(ir: DataFrame) -> DataFrame:
    return ir.select(F.col("path").alias("file"), F.posexplode("local_types").alias("pos", "t")).select("file", "pos", "t.*").withColumn("scope", F.when(F.col("scope").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("::"), "scope")))
