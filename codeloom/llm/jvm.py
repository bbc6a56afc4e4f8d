"""Java functions of this subpackage: compiled once for a session by the compiler that Spark brings for its own code, and sent to executors.

The jar goes to the shared folder and is named by its source's hash. No build step, no other dependency.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from codeloom.llm.shared import scratch_folder

FUNCTIONS = {"codeloom_pack_ids": "codeloom.TokenBlocks$Pack", "codeloom_unpack_ids": "codeloom.TokenBlocks$Unpack"}


def jar_of(classes: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as jar:
        for name, code in sorted(classes.items()):
            jar.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), code)
    return out.getvalue()


def register_functions(spark: SparkSession) -> None:
    """Makes FUNCTIONS callable in this session; each takes and returns a binary."""
    if spark.catalog.functionExists("codeloom_unpack_ids"):
        return
    source = Path(__file__).with_name("TokenBlocks.java").read_text()
    jvm, context = spark._jvm, spark.sparkContext
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(source)
    classes = {entry.getKey(): bytes(entry.getValue()) for entry in compiler.getBytecodes().entrySet()}
    jar = jar_of(classes)
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{hashlib.sha256(jar).hexdigest()[:16]}.jar")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path, True)
    out.write(jar)
    out.close()
    context._jsc.addJar(system.makeQualified(path).toString())
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for name, of in FUNCTIONS.items():
        made = compiler.getClassLoader().loadClass(of).getDeclaredConstructor(context._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(name, made, kind)
