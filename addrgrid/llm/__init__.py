"""Training-data operators: token counts, byte-level BPE, SimHash groups, URL
filter, language identification, token files, benchmark decontamination,
secret scan, exact dedup by content sort, toxicity, conversation repair,
suffix-array dedup, spelling variants.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Each
module holds one operator; ``queries`` registers them.

Conventions shared by all operators: a null text counts as empty unless the
docstring says otherwise; the id and text columns are parameters; every other
input column is left out of the result unless the docstring says that the
operator carries rows through, so extra columns with clashing names do no harm;
an empty table gives an empty result with the same schema.
"""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value, so a cluster needs no
# copy of it on the workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
