"""Operations on the graph, its text, its vectors and its code symbols."""
