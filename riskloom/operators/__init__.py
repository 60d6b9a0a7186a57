"""Operations from frames to frames."""
