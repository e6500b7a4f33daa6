"""Operations on training text: one module per operator, registered in ``refscan.llm.queries``."""
