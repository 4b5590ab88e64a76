"""Names of the queries of this subpackage, what runs them, and the SQL they must agree with."""

from emberline.llm.bpe import op5_merge_rounds
from emberline.llm.jaccard import OP7_SQL, op7_chosen_path
from emberline.llm.language import op10_script_viterbi
from emberline.llm.lexical import OP12_SQL, op12_pair_bound_maxscore
from emberline.llm.lines import OP2_SQL, op2_line_spread
from emberline.llm.mixing import OP4_SQL, op4_weighted_mix
from emberline.llm.pages import op13_block_tree
from emberline.llm.quality import OP3_SQL, op3_line_rules
from emberline.llm.search import OP9_SQL, op9_pivot_table
from emberline.llm.shards import op1_vector_packing
from emberline.llm.surrogates import op8_keyed_surrogates
from emberline.llm.toxicity import op6_noisy_channel
from emberline.llm.whitening import op11_weighted_whitening

QUERIES = {
    "op1_vector_packing": op1_vector_packing,
    "op2_line_spread": op2_line_spread,
    "op3_line_rules": op3_line_rules,
    "op4_weighted_mix": op4_weighted_mix,
    "op5_merge_rounds": op5_merge_rounds,
    "op6_noisy_channel": op6_noisy_channel,
    "op7_chosen_path": op7_chosen_path,
    "op8_keyed_surrogates": op8_keyed_surrogates,
    "op9_pivot_table": op9_pivot_table,
    "op10_script_viterbi": op10_script_viterbi,
    "op11_weighted_whitening": op11_weighted_whitening,
    "op12_pair_bound_maxscore": op12_pair_bound_maxscore,
    "op13_block_tree": op13_block_tree,
}
ORACLES = {
    "op2_line_spread": OP2_SQL,
    "op3_line_rules": OP3_SQL,
    "op4_weighted_mix": OP4_SQL,
    "op7_chosen_path": OP7_SQL,
    "op9_pivot_table": OP9_SQL,
    "op12_pair_bound_maxscore": OP12_SQL,
}
