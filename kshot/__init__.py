"""kshot: few-shot data preparation, sampling and evaluation as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` (or ``Column -> Column``) function.  Random
draws are keyed hashes, never ``rand()``, so results do not depend on partitioning or retries.
"""

__version__ = "0.1.0"
