"""Training-data pipeline operators.

Ten operators over document tables: sharding, near-duplicate detection,
subword encoding, weakly supervised quality rules, WARC archives, secret
scanning, benchmark decontamination, token counting, a rule-ensemble quality
classifier and fuzzy line deduplication.  Nothing else in the package imports
this subpackage.
"""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
