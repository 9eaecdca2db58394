"""Tables -> typed graphs, text corpora and training features, as Spark DataFrame jobs."""

from gridweave.functions.text import pad_mask, pad_or_truncate, split_sentences, tokenize
from gridweave.functions.sql import register_functions
from gridweave.functions.nodes import node_id, node_type_code, parse_node_id
from gridweave.operators.attention import (
    Head,
    attention_layer,
    edge_softmax,
    random_heads,
    relational_attention,
)
from gridweave.operators.contrast import contrastive_loss, mean_loss, retrieval_top1
from gridweave.operators.cooccurrence import cooccurrences, count_vectors, factorize, positive_pmi
from gridweave.operators.masking import Masking, mask_nodes, masked_relations, relations_touching
from gridweave.operators.numbering import (
    assign_gid,
    dense_index,
    epoch_order,
    node_positions,
    number_in_input_order,
)
from gridweave.operators.permutation import (
    Permutation,
    epoch_permutation,
    graphs_at_steps,
    steps_of,
)
from gridweave.operators.rare_words import frequent_word_counts
from gridweave.operators.relations import (
    edge_relations,
    relation_channels,
    relation_multiplicity,
)
from gridweave.operators.sampling import (
    alias_table,
    kept_words,
    negative_samples,
    negative_weights,
    skipgram_pairs,
)
from gridweave.operators.subgraph import (
    distinct_edges,
    edge_positions,
    graph_batch,
    induced_subgraph,
    search_graph,
    search_graph_by_id,
)
from gridweave.operators.tables import (
    filter_table_size,
    fits_size_limit,
    graph_count,
    table_edges,
    table_nodes,
)
from gridweave.operators.vectors import embed_text, fit_word2vec, skipgram_scores, vector_count
from gridweave.operators.vocabulary import (
    build_dictionary,
    dictionary_size,
    distinct_texts,
    number_words,
    sentence_count,
    skipgram_sentences,
    token_sequences,
    tokens_to_ids,
    word_counts,
)
from gridweave.plans.increments import (
    append_records,
    read_increments,
    read_increments_corpus,
    read_ledger,
)
from gridweave.plans.preprocess import (
    build_dictionary_file,
    build_graph,
    build_stores,
    numbered_tables,
)
from gridweave.plans.pretraining import (
    mask_features,
    node_features,
    pretraining_loss,
    training_examples,
    write_examples,
)
from gridweave.session import at_least_parallel, configure, materialize
from gridweave.sources.datasource import register_interactions
from gridweave.sources.interactions import parse_interactions, read_lines, table_texts
from gridweave.sources.stores import (
    Graph,
    read_corpus,
    read_corpus_lines,
    read_dictionary,
    read_graph,
    read_graph_count,
    read_id_only_graph,
    read_vectors,
    read_word_vectors,
    write_corpus,
    write_dictionary,
    write_graph,
    write_graph_count,
    write_id_only_graph,
    write_vectors,
    write_word_vectors,
)
