"""Functions in Java, for arithmetic within a group that has no column expression and costs too much in numpy's calls.

Janino, which Spark brings along for the code that it generates, compiles them; the jar goes to the executors.
"""

from __future__ import annotations

import pkgutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_made: dict[tuple[str, str], object] = {}


def _instance(spark: SparkSession, name: str):
    """An instance of the class, whose jar the application has; once for each application."""
    key = spark.sparkContext.applicationId, name
    if key not in _made:
        jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__name__, f"{name}.java").decode())
        jar = f"{tempfile.mkdtemp(prefix='graphtide-')}/{name}.jar"
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
            for made, code in compiler.getBytecodes().items():
                z.writestr(f"{made.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        made = compiler.getClassLoader().loadClass(f"graphtide.{name}")
        _made[key] = made.getDeclaredConstructor(new(jvm.Class, 0)).newInstance(new(jvm.Object, 0))
    return _made[key]


def registered(spark: SparkSession, name: str, returns: str) -> str:
    """Registers the class of `name`.java with the session; gives the name for call_function. `returns` is the result's type."""
    function = f"graphtide_{name.lower()}"
    spark._jsparkSession.udf().register(function, _instance(spark, name), spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return function
